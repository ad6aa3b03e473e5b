"""The whole run of the corpus pipeline, each stage against a brute-force version on what the stage before wrote."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_structured import WORD, slow_dedup, slow_groups, slow_judge, water
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import mixing, quality_rules
from barloom.llm.queries.texts import TOKENIZER


def fixture():
    """Rows of documents (junk, near and exact copies, shared lines, one source far larger than the others) and of labels."""
    rnd = random.Random(21)
    line = lambda: " ".join(f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(6, 14)))
    shared = [line() for _ in range(12)]
    rows = []
    for i in range(900):
        lines = [line() for _ in range(rnd.randint(2, 22))]
        if rows and rnd.random() < 0.15:  # a copy of one before, with an edit or without
            lines = rnd.choice(rows)[1].split("\n")
            if rnd.random() < 0.6:
                lines[rnd.randrange(len(lines))] += f" e{rnd.randint(0, 99)}"
        if rnd.random() < 0.2:
            lines.insert(rnd.randint(0, len(lines)), rnd.choice(shared) + rnd.choice(["", " \t"]))
        if rnd.random() < 0.08:
            lines = [x.replace(" ", "## ").upper() for x in lines]
        rows.append((i, "\n".join(lines), ["en", "en", "en", "fr"][i % 4], ["big", "big", "big", "small", None, "B"][rnd.randint(0, 5)]))
    labels = [(i, int("##" not in t)) for i, t, *_ in rows if i % 7]
    return rows, labels


def slow_rates(rows, cap=3):
    """The rate of every (source, size) by bisection on each source's dual variable, and the targets."""
    sizes = Counter((s, len(WORD.findall(t or ""))) for _, t, _, s in rows)
    names = sorted({s for s, _ in sizes if s is not None}, key=lambda s: s.encode()) + ([None] if any(s is None for s, _ in sizes) else [])
    total = {s: sum(z * n for (a, z), n in sizes.items() if a == s) for s in names}
    targets = dict(zip(names, water([total[s] for s in names], [1 + i % 3 for i in range(len(names))], cap), strict=True))
    rates = {}
    for s in names:
        cells = {z: n for (a, z), n in sizes.items() if a == s}
        mean = total[s] / sum(cells.values())
        rate = lambda lam, z: cap / (1 + (cap - 1) * math.exp(min(700, max(-700, -lam * z / mean))))  # noqa: B023, E731
        low, high = -1e3, 1e3
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if sum(z * n * rate(mid, z) for z, n in cells.items()) > targets[s] else (mid, high)
        full = targets[s] >= cap * total[s] * (1 - 1e-12)
        rates |= {(s, z): float(cap) if full else rate(low, z) for z in cells}
    return rates, targets, sizes


def test_rates_against_bisection(spark):
    rows, _ = fixture()
    rates, targets, _ = slow_rates(rows)
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect():
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert r["rate"] == pytest.approx(rates[r["source"], r["__size"]], rel=1e-5, abs=1e-8)


def test_run_against_brute_force(spark, tmp_path, monkeypatch):
    at, lib = str(tmp_path), Tokenizer.from_file(TOKENIZER)
    rows, labels = fixture()
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    monkeypatch.setattr(corpus_pipeline, "stage_path", lambda spark, name: f"{at}/{name}")
    last = corpus_pipeline.run(spark, at).collect()
    made = [[(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{at}/stage{i}").collect()] for i in range(4)]
    texts = lambda rows: {i: t for i, t, *_ in rows}

    tuned = {r[0] for r in docs.where(F.pmod(F.xxhash64(F.lit("tuning"), F.col("doc_id")), F.lit(quality_rules.TUNING_OF)) == 0).select("doc_id").collect()}
    verdicts, steps = slow_judge([(i, t, lang) for i, t, lang, _ in rows], labels, tuned.__contains__)
    assert "en" in steps and sorted(made[0]) == sorted((r for r in rows if verdicts[r[0]] == (False, [])), key=lambda r: r[0])
    assert any(rejected and not failed for failed, rejected in verdicts.values())

    assert len(made[1]) == len(made[0]) and texts(made[1]) == slow_dedup([(i, t) for i, t, *_ in made[0]]) != texts(made[0])

    groups = slow_groups([(i, t) for i, t, *_ in made[1]], 5, 80)
    assert sorted(r[0] for r in made[2]) == sorted(i for i, (_, head) in groups.items() if head == i) and set(made[2]) < set(made[1])

    rates, targets, sizes = slow_rates(made[2])
    assert set(made[3]) <= set(made[2])
    copies, taken = Counter(made[3]), Counter()
    assert max(copies.values()) <= 3
    for (_, t, _, s), n in copies.items():
        taken[s, len(WORD.findall(t))] += n
    # the ladder ends with the rung of the smallest texts, at most a quarter octave wide, which leaves half a text of it at most
    for s, target in targets.items():
        least = min(z for a, z in sizes if a == s and z)
        assert abs(sum(z * n for (a, z), n in taken.items() if a == s) - target) <= 2**0.25 * least / 2
    # rounding leaves less than a copy of each cell open, and the ladder moves a few
    assert all(abs(taken[c] - rates[c] * n) <= 3 for c, n in sizes.items())
    assert sum(abs(taken[c] - rates[c] * n) > 1 for c, n in sizes.items()) <= 8 * len(targets)

    assert Counter(r["doc_id"] for r in last) == Counter(i for i, *_ in made[3])
    for r in last:
        text = texts(made[3])[r["doc_id"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) // 4
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
