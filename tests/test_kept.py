"""Kept results: digests in tasks, committed versions, rejected records, values kept batch by batch."""

import hashlib
import json
import os
import random

import pytest

from barloom.config import Config
from barloom.library import Registry, seed_factors
from barloom.panel import manifest
from barloom.pipeline import PipelineRunner
from barloom.plans.compiler import with_expressions
from barloom.plans.increment import KeptValues, LateRowsError, tail, with_warm_up
from barloom.sources.checked import RejectedError, load_checked
from barloom.sources.committed import ConflictError, ResultSet
from barloom.sources.digests import file_digests, folder_digest, tree_digests
from barloom.sources.readers import DataRequest, SyntheticSource

HEAD = "symbol,trade_date,open,high,low,close,volume"


def test_digests_by_value_and_by_stream_agree(spark, tmp_path):
    rnd = random.Random(1)
    texts = {"a.bin": b"", "b c.bin": rnd.randbytes(5000), "deep/d%20e.bin": rnd.randbytes(10_001)}
    for name, data in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    del texts["a.bin"]  # Spark reads no empty files
    want = {name.rsplit("/", 1)[-1]: (len(data), hashlib.sha256(data).hexdigest()) for name, data in texts.items()}
    for whole in (1 << 20, 100, 0):
        got = {os.path.basename(r["path"]): (r["length"], r["sha256"]) for r in file_digests(spark, str(tmp_path), whole).collect()}
        assert got == want, whole
    trees = {os.path.basename(r["path"]): (r["pieces"], r["sha256"]) for r in tree_digests(spark, str(tmp_path), 1000).collect()}
    for name, data in texts.items():
        parts = [data[i : i + 1000] for i in range(0, len(data), 1000)]
        assert trees[name.rsplit("/", 1)[-1]] == (len(parts), hashlib.sha256("".join(hashlib.sha256(p).hexdigest() for p in parts).encode()).hexdigest())


def test_digest_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    path, size = tmp_path / "sparse.bin", (3 << 30) + 5
    with open(path, "wb") as f:
        f.truncate(size)
    h, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size >> 24):
        h.update(zeros)
    h.update(bytes(size & ((1 << 24) - 1)))
    assert folder_digest(file_digests(spark, str(path))) == h.hexdigest()
    assert [(r["length"], r["pieces"]) for r in tree_digests(spark, str(path)).collect()] == [(size, 13)]


def test_versions_are_committed_whole(spark, tmp_path, monkeypatch):
    rs = ResultSet(spark, str(tmp_path / "set"))
    assert rs.versions() == []
    with pytest.raises(FileNotFoundError):
        rs.table("t")
    df = spark.range(7)
    assert rs.commit({"t": df}, {"by": "test"}, {"note.txt": "first\nünicode"}, after=0, checksums=True) == 1
    assert rs.text("note.txt") == "first\nünicode" and rs.manifest()["facts"] == {"by": "test"} and rs.manifest()["tables"]["t"]["rows"] == 7

    class Killed(BaseException):
        pass

    def die(told):
        raise Killed

    with monkeypatch.context() as m:  # the run ends when its tables are written and its manifest is not
        m.setattr(rs, "_publish", die)
        with pytest.raises(Killed):
            rs.commit({"t": spark.range(99), "u": df})
    assert len(os.listdir(tmp_path / "set/data")) == 2
    again = ResultSet(spark, str(tmp_path / "set"))
    assert again.versions() == [1] and again.table("t").count() == 7
    with pytest.raises(KeyError):
        again.table("u")
    with pytest.raises(ConflictError):
        again.commit({"t": df}, after=0)
    assert again.commit({"t": spark.range(3)}, after=1) == 2
    assert again.table("t").count() == 3 and again.table("t", 1).count() == 7 and again.history("t").count() == 10
    with pytest.raises(ConflictError):  # a name is never taken twice
        again._publish({"version": 2})
    assert again.table("t").count() == 3 and not [n for n in os.listdir(tmp_path / "set/manifests") if n.endswith(".tmp")]
    assert again.damaged(1) == [] and again.damaged() == []
    at = tmp_path / "set" / again.manifest(1)["data"] / "t"
    spark.range(7, 14).write.mode("overwrite").parquet(str(at))
    assert again.damaged(1) == ["t"]
    with pytest.raises(ValueError):
        again.commit({"../t": df})
    empty = again.commit({"none": df.limit(0)})
    assert again.table("none", empty).columns == ["id"] and again.table("none", empty).count() == 0


def test_rejected_records_of_csv(spark, tmp_path):
    lines = [HEAD, "001,2022-01-03,1,2,1,1.5,10", "002,20220103,1,2,1,n/a,10", "003,2022-13-41,1,2,1,1,10", ",2022-01-03,1,2,1,1,10", "004,,1,2,1,1,10", "005,2022-01-03,1,2", "006,2022-01-03,1,2,1,1,10,11", "007,2022-01-03,,2,NaN,1,10"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    got = load_checked(spark, DataRequest(str(tmp_path / "a.csv")), most=1)
    assert sorted(r["symbol"] for r in got.good.collect()) == ["001", "007"] and "__why" not in got.good.columns
    assert got.counts == {"malformed record": 2, "no symbol": 1, "no trade_date": 1, "unreadable close": 1, "unreadable trade_date": 1} and got.rows == 8 and got.share == 0.75
    rejected = {r["reason"]: r for r in got.rejected.collect() if r["reason"] != "malformed record"}
    assert json.loads(rejected["unreadable close"]["record"])["symbol"] == "002" and rejected["no symbol"]["file"].endswith("a.csv")
    assert {r["record"] for r in got.rejected.where("reason = 'malformed record'").collect()} == {lines[6], lines[7]}
    with pytest.raises(RejectedError, match="6 of 8"):
        load_checked(spark, DataRequest(str(tmp_path / "a.csv")), most=0.7)
    assert load_checked(spark, DataRequest(str(tmp_path / "a.csv"), symbols=["007"]), most=1).good.count() == 1
    assert manifest(got.good, "csv", str(tmp_path / "a.csv"), got.counts)["rejected_records"] == got.counts
    (tmp_path / "none.csv").write_text(HEAD + "\n")
    none = load_checked(spark, DataRequest(str(tmp_path / "none.csv")))
    assert none.rows == 0 and none.counts == {} and none.share == 0 and none.good.count() == 0


def test_rejected_records_of_json_and_parquet(spark, tmp_path):
    row = lambda s, **kw: json.dumps({"Ticker": s, "Date": "2022-01-03", "close": 1.5, **kw})
    folder = tmp_path / "in.json"
    folder.mkdir()
    (folder / "lines.json").write_text("\n".join([row("a")[:-3], row("b"), "", row("c", close="x"), row("d", is_st="perhaps"), row("e", close=None), "[oops"]))
    (folder / "array.json").write_text("[" + row("f") + ",\n" + row("g", Date="soon") + "]")
    (folder / "broken.json").write_text("[" + row("h") + ",\n")
    got = load_checked(spark, DataRequest(str(folder)), most=1)
    assert sorted(r["symbol"] for r in got.good.collect()) == ["b", "e", "f"]
    assert got.counts == {"malformed record": 3, "unreadable close": 1, "unreadable is_st": 1, "unreadable trade_date": 1}
    assert row("a")[:-3] in {r["record"] for r in got.rejected.collect()}
    spark.createDataFrame([("a", "2022-01-03", 1.0), (None, "2022-01-03", 2.0), ("c", "x", float("nan"))], "symbol string, trade_date string, close double").write.parquet(str(tmp_path / "p.parquet"))
    assert load_checked(spark, DataRequest(str(tmp_path / "p.parquet")), most=1).counts == {"no symbol": 1, "unreadable trade_date": 1}
    spark.range(2).write.parquet(str(tmp_path / "q.parquet"))
    assert load_checked(spark, DataRequest(str(tmp_path / "q.parquet")), most=1).counts == {"no symbol": 2}


EXPRESSIONS = {"a": "ts_mean(close, 7) - delay(close, 5)", "b": "ts_rank(ts_std(close, 4), 6)", "c": "corr(close, ret(volume, 3), 12)", "d": "close + 1"}


def bars(spark, n=500, seed=5):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot"] * 5 + ["b", "c", "late" if i > n / 2 else "gone"]), i, None if rnd.random() < 0.1 else rnd.random(), float(rnd.randint(1, 9))) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, trade_date int, close double, volume double").repartition(3)


def close(got, want, names):
    rows = {(r["symbol"], r["trade_date"]): r for r in want}
    for r in got:
        w = rows[r["symbol"], r["trade_date"]]
        for c in names:
            assert (r[c] is None and w[c] is None) or abs(r[c] - w[c]) < 1e-9, (r, w)


@pytest.mark.parametrize("cuts", [[500], [60, 61, 300, 500], [3, 200, 201, 202, 203, 500]])
def test_kept_values_equal_the_full_run(spark, tmp_path, cuts):
    panel, kept, after = bars(spark), KeptValues(spark, str(tmp_path / "kept"), EXPRESSIONS), 0
    for i, until in enumerate(cuts):
        batch = panel.where(f"trade_date >= {after} and trade_date < {until}")
        assert kept.append(batch, slices=3 if i == 1 else None) == i + 1
        after = until
    got = kept.values().collect()
    assert len(got) == 500
    close(got, with_expressions(panel, EXPRESSIONS).collect(), EXPRESSIONS)
    state = kept.results.table("state")
    assert max(r["count"] for r in state.groupBy("symbol").count().collect()) == kept.back == 14


def test_kept_values_refuse_what_they_cannot_place(spark, tmp_path):
    panel, kept = bars(spark), KeptValues(spark, str(tmp_path / "kept"), {"x": "close + 1"})
    kept.append(panel.where("trade_date < 100"))
    for bad in ("trade_date between 50 and 150", "trade_date < 100"):  # the last date of each symbol is known though nothing looks back
        with pytest.raises(LateRowsError):
            kept.append(panel.where(bad))
    with pytest.raises(LateRowsError):
        kept.append(panel.where("trade_date >= 100").selectExpr("symbol", "nullif(trade_date, 300) as trade_date", "close"))
    assert kept.append(panel.where("trade_date >= 100").unionByName(panel.limit(1).selectExpr("cast(null as string) symbol", "trade_date", "close", "volume"))) == 2
    assert kept.append(panel.limit(0)) == 3 and kept.values().count() == 500
    with pytest.raises(ValueError, match="other expressions"):
        KeptValues(spark, str(tmp_path / "kept"), {"x": "close + 2"}).append(panel.limit(0))
    with pytest.raises(ValueError, match="look-back"):
        KeptValues(spark, str(tmp_path / "kept"), {"x": "zscore(close)"})


def test_warm_up(spark):
    panel = bars(spark).selectExpr("*", "'kept' as note")
    before, after = panel.where("trade_date < 250").drop("note"), panel.where("trade_date >= 250")
    got = with_warm_up(before, after, EXPRESSIONS)
    assert got.columns == [*panel.columns, *EXPRESSIONS]
    rows = got.collect()
    assert len(rows) == 250 and {r["note"] for r in rows} == {"kept"}
    close(rows, with_expressions(panel, EXPRESSIONS).collect(), EXPRESSIONS)
    assert tail(panel, 2).where("symbol = 'hot'").count() == 2 and tail(panel.limit(0), 2).count() == 0


def test_run_with_warm_up_is_committed(spark, tmp_path):
    c = Config.from_dict({"data": {"train_start": "2022-01-03", "train_end": "2022-04-29", "oos_start": "2022-05-02", "oos_end": "2022-06-30"}, "output_dir": str(tmp_path / "out")})
    c.quality.truncation_test_dates = 1
    panel = SyntheticSource(8).load(spark, DataRequest(start_date=c.data.train_start, end_date=c.data.oos_end))
    seeds = [f for f in seed_factors() if f.factor_id in ("seed_006", "seed_010")]
    out = PipelineRunner(spark, c, Registry(seeds), warm_up=True, results=str(tmp_path / "set")).run(panel=panel)
    assert out["version"] == 1 and {r["coverage"] for r in out["oos"]} == {1.0}
    rs = ResultSet(spark, str(tmp_path / "set"))
    assert rs.table("oos").count() == 2 and rs.table("portfolio").count() == 3 and rs.text("report.html").startswith("<!DOCTYPE")
    cold = PipelineRunner(spark, c, Registry([f for f in seed_factors() if f.factor_id in ("seed_006", "seed_010")])).run(panel=panel)
    assert min(r["coverage"] for r in cold["oos"]) < 0.6 and "version" not in cold
