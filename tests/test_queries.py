import os

import duckdb
import pytest

import __spark_entry__ as entry
from barloom.queries import QUERIES, SQL
from barloom.streaming.bars import streaming_bars

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["src_panel_months", "src_normalized", "flt_symbols_in", "val_missing_rates", "val_ohlc_logic", "ts_rank", "ts_corr", "cs_rank_date", "cs_winsorize_symbol", "op_compare", "op_bool", "ts_missing_values",
        "factor_017", "src_csv_roundtrip", "src_json_roundtrip", "expr_hash", "dedup_structural", "q_complexity", "daily_rankic", "metrics_all", "classify", "factor_corr_pairs", "dedup_numerical", "oos_decay", "weights_long_short", "port_summary_long_short", "port_prices_long_short", "port_prices_bottom", "q_truncation_rank",
        "ts_slices_events", "cs_rank_date_ranges", "daily_rankic_raw", "daily_rankic_ranges", "rank_turnover_raw", "factor_corr_blocks", "dedup_numerical_rounds", "q_truncation_ts", "q_gate", "val_profile", "val_ohlc_anomaly", "q_near_constant",
        "src_checked_good", "src_checked_rejected", "snk_committed", "kept_values", "oos_warm"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or v != v else round(v, 9) + 0.0 if isinstance(v, float) else str(v).replace(" 00:00:00", "")


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda row: tuple(map(str, row))
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=key)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=key)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 21
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming_bars(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "user_id", "value", "event_id")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming_bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in streaming_bars(events).collect()}
    assert {tuple(r) for r in spark.sql("select * from bars").collect()} == want
