"""Operator 4: the permutation, the files and the rows against brute force."""

import base64
import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from barloom.llm import training_order as to
from barloom.llm.common import stretch

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, slot long, shard string"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 65_537])
@pytest.mark.parametrize("key", [0, 7, -3])
def test_permutation(n, key):
    p = to.Permutation(n, key)
    s = p.slots(np.arange(n))
    assert sorted(s.tolist()) == list(range(n)) and (p.sequences(s) == np.arange(n)).all()
    if n > 900:
        assert abs(np.corrcoef(np.arange(n), s)[0, 1]) < 0.1 and (s != to.Permutation(n, key + 1).slots(np.arange(n))).mean() > 0.99


def stream(rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d, t in rows:
        out += [(d, i) for i in [*e.encode_ordinary(t or ""), 50256]]
    return out


def run(spark, rows, folder, length):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], SCHEMA).repartition(3)
    return to.materialise(df, RANKS, public_tokenizers.PATTERN, str(folder), length=length, key=11).collect()


def test_files_and_rows(spark, tmp_path):
    rows = [(None, "no id"), (1, "a few words"), (2, None), (3, ""), (5, "long words " * 4000), (8, "été 日本"), (2**50, "far away")] + [(100 + i, f"document number {i} " * (i % 9)) for i in range(300)]
    got = run(spark, rows[::-1] + [rows[1], rows[1]], tmp_path / "s", 64)
    tokens = stream(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    n = -(-len(tokens) // 64)
    order = to.Permutation(n, 11)
    assert sorted(r["slot"] for r in got) == list(range(n))
    files = list(to.read_slots(str(tmp_path / "s")))
    assert len(files) == n
    for r in got:
        part = tokens[r["sequence"] * 64 : (r["sequence"] + 1) * 64]
        ids = [i for _, i in part] + [50256] * (64 - len(part))
        assert r["slot"] == order.slots(np.array([r["sequence"]]))[0] and r["n_tokens"] == len(part) and r["first_doc_id"] == part[0][0]
        assert files[r["slot"]].tolist() == ids and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u2").tobytes()).hexdigest()
    some = list(to.read_slots(str(tmp_path / "s"), n // 2, 70))
    assert [x.tolist() for x in some] == [x.tolist() for x in files[n // 2 : n // 2 + 70]]
    again = run(spark, rows, tmp_path / "t", 64)
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path / "e", 64) == [] and list(to.read_slots(str(tmp_path / "e"))) == []
    one = run(spark, [(1, "x")], tmp_path / "o", 64)
    assert len(one) == 1 and one[0]["n_tokens"] == 2


def test_places_on_any_ids(spark):
    ids = [*range(3000), 2**61, -(2**62), *[None] * 2500, *[77] * 1500]
    rows = [(d, n * 7919 % 100_003 - 50_000, n % 5 + 1) for n, d in enumerate(ids)]
    counts = spark.createDataFrame(rows, "__id long, __body long, n long")
    got = {(r["__id"], r["__body"]): r["start"] for r in to._layout(counts).collect()}
    at, want = 0, {}
    for d, b, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want[d, b] = at
        at += n
    assert got == want
    sizes = counts.groupBy(stretch(counts.select("__id", "__body"), to.STRETCH)).count()
    assert sizes.agg(F.max("count")).first()[0] <= to.STRETCH


def test_both_ways_to_place_documents(spark, tmp_path, monkeypatch):
    rows = [(None, "no id"), (7, None)] + [(i % 250, f"document number {i} " * (i % 9)) for i in range(300)]
    near = run(spark, rows + rows[:9], tmp_path / "a", 64)
    monkeypatch.setattr(to, "BROADCAST_DOCS", 0)
    monkeypatch.setattr(to, "CUT_BYTES", 100)
    monkeypatch.setattr(to, "MOST_PARTITIONS", 2)
    assert sorted(map(tuple, run(spark, rows, tmp_path / "b", 64))) == sorted(map(tuple, near))
    assert [x.tolist() for x in to.read_slots(str(tmp_path / "a"))] == [x.tolist() for x in to.read_slots(str(tmp_path / "b"))]
    assert not [f for f in (tmp_path / "a").iterdir() if f.name.startswith(".") and "crc" not in f.name]


def test_missing_pieces_are_an_error(tmp_path):
    order, b = to.Permutation(3, 1), []
    for start, n in ((0, 70), (70, 80)):
        ids = np.arange(n, dtype="<u2").tobytes()
        b.append(pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([start], pa.int64()), pa.array([ids], pa.binary())], names=["i", "s", "ids"]))
    for parts, fails in (([0, 1], False), ([0, 1, 1, 0], False), ([0], True), ([1], True)):
        w = to._ShardWriter(str(tmp_path), 150, 64, 64, "<u2", 9)
        for p in parts:
            for r in to._parcels(b[p], order, 64, 64, "<u2").to_pylist():
                w.add(r["shard"], r["pieces"], r["ids"])
        if fails:
            with pytest.raises(RuntimeError):
                w.finish(order)
        else:
            got = w.finish(order).to_pylist()
            assert [r["n_tokens"] for r in sorted(got, key=lambda r: r["sequence"])] == [64, 64, 22] and all(r["first_doc_id"] is None for r in got)
