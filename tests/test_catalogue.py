"""Registered queries against their DuckDB SQL on small data, and the driver's entry points."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
SOME = [
    "op_math_div", "op_window_zscore", "op_indicator_beta", "op_indicator_rsi", "op_indicator_atr", "op_panel_winsorize", "op_weight_market_neutral", "op_gate_cooldown", "op_decision_strict_and", "op_state_fsm", "case_residual_mean_reversion",
    "op_state_delay_skip", "op_state_accumulate_reset_sum", "case_state_cooldown", "case_custom_token_level", "graph_ema_cross", "frame_market_violations", "op_math_round", "op_score_zscore"]


def norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    base = duckdb.connect()
    for t in TABLES:
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    wanted = base.sql(__spark_entry__.oracle_sql()[name]).select(*columns).fetchall()
    assert norm(tuple(r) for r in df.select(*columns).collect()) == norm(wanted)


def test_weighted_vote_adds_in_event_order(spark, tmp_path):
    """Both sides weigh 67.79; the doubles' sum is above zero in event order, and zero in the other orders below."""
    values = [(2, 30.59), (3, 1.04), (4, 36.16), (5, 67.79)]
    rows = [(1 + 77 * e, f"2024-01-01 00:00:0{e}", 7, "view", v) for e, v in values]
    base = duckdb.connect()
    base.sql("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    base.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", rows)
    wanted = base.sql(__spark_entry__.oracle_sql()["op_decision_weighted_vote"]).select("user_id", "day", "kind", "reasons").fetchall()
    assert wanted == [(7, "2024-01-01", "accept", "VIEW")]
    for order in ((0, 1, 2, 3), (0, 2, 1, 3), (1, 3, 0, 2), (3, 1, 0, 2)):
        dealt = [rows[i] for i in order]
        path = f"{tmp_path}/{len(os.listdir(tmp_path))}"
        table = spark.createDataFrame(dealt, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
        table.coalesce(1).write.parquet(f"{path}/events.parquet")
        found = __spark_entry__.queries()["op_decision_weighted_vote"](spark, path).select("user_id", "day", "kind", "reasons")
        assert [tuple(r) for r in found.collect()] == wanted


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["event_id", "user_id", "kind", "reasons"]
