"""What ``__spark_entry__`` adds where this subpackage is installed."""

from __future__ import annotations

import re

from . import queries as _queries
from . import sql as _sql


def queries() -> dict:
    found = {k: f for k, f in vars(_queries).items() if re.match(r"op\d+_", k)}
    return dict(sorted(found.items(), key=lambda x: int(re.findall(r"\d+", x[0])[0])))


def oracle_sql() -> dict[str, str]:
    return dict(_sql.ORACLE)
