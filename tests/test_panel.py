import datetime
import hashlib
import json

import pytest

from barloom.config import Config
from barloom.log import set_up
from barloom.operators.boundary import LeakageError, LeakageGuard, SampleBoundary
from barloom.panel import fingerprint, manifest, normalize, profile, validate
from barloom.sources import datasets
from barloom.sources.readers import SOURCES, DataRequest, FileSource, SyntheticSource
from barloom.sources.sinks import write_table

CSV = "ts_code,trade_date,open,high,low,close,vol,amount,pct_chg\n000001,20220103,1,2,0.5,1.5,100,150,0.1\n000001,20220104,1,2,0.5,1.5,x,150,0.1\n000002,20220103,1,2,0.5,1.5,100,150,0.1\n"


@pytest.fixture
def vendor(tmp_path):
    p = tmp_path / "a.csv"
    p.write_text(CSV)
    return str(p)


def test_vendor_csv(spark, vendor):
    df = SOURCES["vendor_a"].load(spark, DataRequest(vendor))
    rows = {(r["symbol"], r["trade_date"]): r for r in df.collect()}
    assert ("000001", datetime.date(2022, 1, 3)) in rows  # leading zeros and compact dates survive
    assert rows["000001", datetime.date(2022, 1, 4)]["volume"] is None
    assert "pct_change" in df.columns and rows["000002", datetime.date(2022, 1, 3)]["market"] == "CN"


def test_request(spark, vendor):
    load = lambda **kw: FileSource().load(spark, DataRequest(vendor, **kw))
    assert load(start_date="2022-01-04").count() == 1
    assert load(symbols=["000002"]).count() == 1
    assert load(symbols=[f"{i:06d}" for i in range(2, 2000)]).count() == 1
    assert set(load(fields=["close"]).columns) == {"symbol", "trade_date", "close", "market", "exchange"}


def test_formats(spark, vendor, tmp_path):
    base = FileSource().load(spark, DataRequest(vendor)).drop("market", "exchange")
    for fmt in ("parquet", "csv"):
        write_table(base, str(tmp_path / f"b.{fmt}"), fmt)
        assert SOURCES[fmt].load(spark, DataRequest(str(tmp_path / f"b.{fmt}"))).count() == 3
    (tmp_path / "c.json").write_text('[{"symbol": "007", "trade_date": "2022-01-03", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 5}]')
    r = SOURCES["vendor_c"].load(spark, DataRequest(str(tmp_path / "c.json"))).first()
    assert r["symbol"] == "007" and r["volume"] == 5.0
    with pytest.raises(FileNotFoundError):
        SOURCES["csv"].load(spark, DataRequest(str(tmp_path / "none.csv")))
    with pytest.raises(ValueError):
        SOURCES["csv"].load(spark, DataRequest(str(tmp_path / "c.json")))


def test_names_must_not_clash(spark):
    with pytest.raises(ValueError):
        normalize(spark.createDataFrame([("a", "b")], "date string, datetime string"))


def test_validate(spark):
    schema = "symbol string, trade_date date, open double, high double, low double, close double, volume double"
    d = datetime.date(2022, 1, 3)
    assert validate(spark.createDataFrame([("a", d, 1.0, 2.0, 0.5, 1.5, 10.0)], schema)) == []
    found = validate(spark.createDataFrame([("a", d, 1.0, 0.9, 0.5, 1.5, -1.0), ("a", d, 0.0, None, 0.5, 1.5, 1.0)], schema))
    assert len(found) == 4 and any("repeat" in x for x in found) and any("contradict" in x for x in found)
    assert validate(spark.createDataFrame([], schema)) == []
    assert validate(spark.createDataFrame([("a",)], "symbol string"))[0].startswith("missing")


def test_profile_and_manifest(spark, vendor):
    df = FileSource().load(spark, DataRequest(vendor))
    p = profile(df)
    assert p["rows"] == 3 and p["n_symbols"] == 2 and p["duplicate_keys"] == 0 and p["missing_rates"] == {"volume": pytest.approx(1 / 3)}
    m = manifest(df, "vendor_a", vendor)
    assert len(m["file_sha256"]) == 64 and m["data_fingerprint"] == fingerprint(df) != fingerprint(df, content=True)


def test_manifest_covers_every_file(spark, vendor, tmp_path):
    df = FileSource().load(spark, DataRequest(vendor))
    parts = tmp_path / "parts"
    parts.mkdir()
    for i in range(10_001):
        (parts / f"part-{i:06d}").write_bytes(b"x")
    told = lambda: manifest(df, "parts", str(parts))["file_sha256"]
    assert told() == hashlib.sha256(hashlib.sha256(b"x").hexdigest().encode() * 10_001).hexdigest()
    (parts / "part-010000").write_bytes(b"y")
    assert told() == hashlib.sha256(hashlib.sha256(b"x").hexdigest().encode() * 10_000 + hashlib.sha256(b"y").hexdigest().encode()).hexdigest()


def test_synthetic_is_sound_and_repeatable(spark):
    req = DataRequest(start_date="2022-01-03", end_date="2022-03-31")
    df = SyntheticSource().load(spark, req)
    assert validate(df) == [] and df.select("symbol").distinct().count() == 50
    assert fingerprint(df, True) == fingerprint(SyntheticSource().load(spark, req).repartition(7), True)


def test_boundary(spark):
    b = SampleBoundary("2020-01-01", "2020-12-31", "2021-01-01", "2021-12-31")
    df = spark.sql("select 's' symbol, explode(sequence(date'2020-12-30', date'2021-01-02')) trade_date")
    assert b.train(df).count() == 2 and b.oos(df).count() == 2
    guard = LeakageGuard(b)
    guard.check_no_oos_rows(b.train(df))
    with pytest.raises(LeakageError):
        guard.check_no_oos_rows(df)
    with pytest.raises(LeakageError):
        guard.check_distinct("x", "x")
    assert len(guard.violations) == 2
    with pytest.raises(ValueError):
        SampleBoundary("2020-01-01", "2021-01-01", "2021-01-01", "2021-12-31")


def test_datasets(spark, tmp_path):
    d = datasets.upload(spark, "../../evil name.csv", CSV.encode(), str(tmp_path / "up"))
    assert d.name == "evil_name.csv" and d.info["rows"] == 3
    assert datasets.check(datasets.load(spark, d.path))["valid"]
    assert datasets.first_rows(spark, d.path, 2).count() == 2
    assert datasets.register_local(spark, d.path).info["n_symbols"] == 2
    with pytest.raises(ValueError):
        datasets.upload(spark, "a.exe", b"", str(tmp_path))


def test_json_lines_and_arrays(spark, tmp_path):
    rows = [{"symbol": f"00{i}", "trade_date": "2022-01-03", "open": 1, "high": 2, "low": 1, "close": 1.5, "volume": i} for i in range(3)]
    texts = {"lines.json": "\n".join(map(json.dumps, rows)), "lines.jsonl": "\n\n" + "\n".join(map(json.dumps, rows)) + "\n", "array.json": json.dumps(rows), "pretty.json": json.dumps(rows, indent=2), "one.json": json.dumps(rows[0], indent=1)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        got = SOURCES["vendor_c"].load(spark, DataRequest(str(tmp_path / name))).collect()
        assert sorted((r["symbol"], r["volume"]) for r in got) == [(r["symbol"], float(r["volume"])) for r in rows][: 1 if name == "one.json" else 3], name
    spark.createDataFrame(rows).repartition(2).write.json(str(tmp_path / "folder.json"))
    assert SOURCES["vendor_c"].load(spark, DataRequest(str(tmp_path / "folder.json"))).count() == 3
    mixed = tmp_path / "both kinds.json"
    mixed.mkdir()
    many = [{"symbol": f"{i:03}", "trade_date": "2022-01-03", "volume": i, **({"note": "{"} if i % 2 else {})} for i in range(106)]
    (mixed / "a b.json").write_text(json.dumps(many[:100]))
    (mixed / "c%20d.json").write_text("\n".join(map(json.dumps, many[100:])))
    (mixed / "e.json").write_text(" \n\n")
    got = SOURCES["vendor_c"].load(spark, DataRequest(str(mixed))).collect()
    assert sorted((r["symbol"], r["volume"]) for r in got) == [(r["symbol"], float(r["volume"])) for r in many]
    (tmp_path / "none.json").write_text("")
    assert SOURCES["vendor_c"].load(spark, DataRequest(str(tmp_path / "none.json"))).count() == 0


def test_configuration_keys(tmp_path, caplog):
    values = {"dedup": {"absolute_correlation_threshold": 0.5}, "factors": {"min_ic_elite": 0.2, "nonsense": 1}, "quality": {"max_window_size": 20, "near_constant_threshold": "1e-6"}, "generation": {"enabled": False}, "log_level": "DEBUG", "portfolio": {"transaction_cost_bps": 3}}
    (tmp_path / "c.json").write_text(json.dumps(values))
    c = Config.from_file(str(tmp_path / "c.json"))
    assert c.dedup.absolute_correlation_threshold == 0.5 and c.factors.least("elite") == [0.2, 0.1, 0.01, 0.1] and c.quality.max_window_size == 20
    assert c.quality.near_constant_threshold == 1e-6 and c.portfolio.transaction_cost_bps == 3.0 and c.log_level == "DEBUG" and c.quality.sample_rows is None
    assert "factors.nonsense" in caplog.text and "generation" not in caplog.text
    assert Config.from_dict(c.to_dict()).fingerprint() == c.fingerprint() != Config().fingerprint()


def test_log_lines(tmp_path):
    set_up("info", str(tmp_path / "logs" / "run.log"), run="r1").info("one line")
    set_up().debug("not told")
    assert "INFO barloom [r1] one line" in (tmp_path / "logs" / "run.log").read_text()
