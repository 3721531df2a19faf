"""Column helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RAISE, NULL = "raise", "null"


def guard(value: Column, bad: Column, code: str, policy: str = RAISE) -> Column:
    """``value`` unless ``bad``: then an error with ``code``, or null under the lenient policy."""
    failed = F.lit(None) if policy == NULL else F.raise_error(F.lit(code))
    return F.when(F.coalesce(bad, F.lit(False)), failed).otherwise(value)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def checked(value: Column, *inputs: Column, policy: str = RAISE) -> Column:
    """``value`` of inputs that must be finite (nulls may be missing rows, and stay null)."""
    bad = ~is_finite(inputs[0].cast("double"))
    for x in inputs[1:]:
        bad = F.coalesce(bad, F.lit(False)) | F.coalesce(~is_finite(x.cast("double")), F.lit(False))
    return guard(value, bad, "NUMERIC_NONFINITE", policy)


def lag_valid(x: Column, steps: int) -> Column:
    """The last but ``steps`` value before this row that is not null; needs ``over``."""
    from pyspark.sql.classic.column import Column as Classic
    from pyspark.sql.classic.column import _to_java_column

    from pyspark import SparkContext

    return Classic(SparkContext._active_spark_context._jvm.org.apache.spark.sql.functions.lag(_to_java_column(x), steps, None, True))


def unsigned_zero(x: Column) -> Column:
    """Minus zero as zero."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def hhmm(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def decision(kind: Column, reason: Column) -> Column:
    """A decision record: kind (accept, reject, unknown, block) and sorted unique reasons."""
    reasons = F.when(reason.isNull(), F.array().cast("array<string>")).otherwise(F.array(reason))
    return F.struct(kind.alias("kind"), reasons.alias("reasons"))


def merged_reasons(*reasons: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*reasons)))
