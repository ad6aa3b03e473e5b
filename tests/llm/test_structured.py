"""Operators 1, 3, 6, 8 and 10 against brute force, and on odd tables."""

import hashlib
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm import components, jaccard, line_dedup, mixing, quality_rules, secrets
from barloom.llm.queries import SQL
from barloom.llm.queries.base import op1_mix_sources, op6_line_dedup, op8_secret_scan

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, hash string, size long, __id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """documents with extra columns whose names could clash."""
    return spark.createDataFrame([(i, t, lang, s, None, 1, "x", 2, "y") for i, t, lang, s in rows], SCHEMA)


ODD = [(1, None, None, None), (2, "", "en", ""), (3, "one", "en", "a"), (3, "one", "en", "a"), (4, "word " * 50_000, None, "b"), (None, "no id at all here", "en", "a"), (None, None, None, None), (5, "é" * 10 + "\n" + "é" * 10, "fr", None)]


# --- 1


def water(sizes, weights, cap):
    """Shares by weight, full sources fixed again and again until none is above its cap."""
    total, full = sum(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        t = [cap * sizes[i] if i in full else rest * weights[i] / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in full and t[i] > cap * sizes[i]}
        if not over:
            return t
        full |= over


def test_targets_and_taken(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * max(1, int(rnd.lognormvariate(4, 1)))), "en", rnd.choice(["Z", "a", "a", "a", "b", "ä", None])) for i in range(900)]
    rows += [(2000, "x y z", "en", "tiny"), (2001, "x", "en", "tiny")]
    out = mixing.mix(table(spark, rows)).collect()
    names = sorted({r[3] for r in rows if r[3] is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len(r[1].split()) for r in rows if r[3] == n) for n in names]
    want = dict(zip(names, water(sizes, [1 + i % 3 for i in range(len(names))], 3), strict=True))
    assert len(out) == len(rows)
    taken = dict.fromkeys(names, 0)
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 3
        assert r["source_size"] == sizes[names.index(r["source"])]
        taken[r["source"]] += r["copies"] * r["__size"]
    for n in names:
        assert abs(taken[n] - want[n]) <= max(3, 0.01 * want[n]), n
    assert want["tiny"] == 12 and taken["tiny"] == 12  # a full source takes every document three times
    again = mixing.mix(table(spark, rows[::-1]).repartition(5)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in out)


def test_rates_solve_the_dual(spark):
    out = mixing.mix(table(spark, [(i, "w " * (1 + i % 37), "en", "ab"[i % 3 == 0]) for i in range(300)]))
    for r in out.groupBy("source").agg(F.sum(F.col("rate") * F.col("__size")).alias("got"), F.first("target").alias("t")).collect():
        assert r["got"] == pytest.approx(r["t"], rel=1e-6)


def test_mix_odd_tables(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    out = mixing.mix(table(spark, ODD)).collect()
    assert len(out) == len(ODD) and {r["source"] for r in out} == {None, "", "a", "b"}
    assert all(r["copies"] == 0 or r["__size"] >= 0 for r in out)
    assert all(r["target"] == 0 for r in mixing.mix(table(spark, [(1, "", "en", "a"), (2, None, "en", "b")])).collect())
    assert op1_mix_sources(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


# --- 3


def slow_profile(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("text", [None, "", "a", "a a a", "a a a a", "a b c a b c", "x\x1cy z\x85w  q", "l\nl\n \nl\nm", "a b c d a b c d e f #| <b>", "é É ß | é É ß |", "\x0b\x0c"])
def test_profile(text):
    assert quality_rules.profile(text)[:5] == slow_profile(text)


def test_profile_of_random_texts():
    rnd = random.Random(1)
    for _ in range(60):
        t = "".join(rnd.choice(["a ", "b ", "c\n", "é ", "# ", "\t"]) for _ in range(rnd.randint(0, 60)))
        assert quality_rules.profile(t)[:5] == slow_profile(t), t


def test_binomial_tail_and_cutoffs():
    from fractions import Fraction
    from math import comb

    for n, k, p in ((10, 0, 0.1), (50, 3, 0.05), (200, 10, 0.02)):
        q = Fraction(p)
        exact = float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))
        assert quality_rules.binomial_cdf(k, n, p) == pytest.approx(exact, rel=1e-9)
    assert quality_rules.accepted([0, 0, 40], 1000, 0.02, 0.01) == 2
    assert quality_rules.accepted([30, 0, 0], 1000, 0.02, 0.01) == 0  # the first failure ends the walk
    assert quality_rules.accepted([0], 50, 0.02, 0.01) == 0  # too few labels to promise anything
    least = quality_rules.least_labels(0.02, 0.05)
    assert quality_rules.accepted([0], least, 0.02, 0.05) == 1 and quality_rules.accepted([0], least - 1, 0.02, 0.05) == 0


def slow_judge(rows, labels, tuning, epsilon=quality_rules.EPSILON, delta=quality_rules.DELTA):
    """Verdicts of (id, text, stratum) by the definitions: every cutoff tried on every document."""
    label = {}
    for i, v in labels:
        if i is not None and v is not None:
            label[i] = max(v, label.get(i, 0))
    per = lambda a, b: a / b if b else 0.0

    def profile(t):
        n, chars, symbols, dup, repeat = slow_profile(t)
        letters = [c for c in t or "" if c.isalpha()]
        upper = [c for c in letters if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×"]
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        digits = len(re.findall("[0-9]", t or ""))
        return n < 50 or 100 * repeat > 50 * n, {
            "symbol_ratio": per(symbols, n), "upper_ratio": per(len(upper), len(letters)), "exclaim_ratio": per((t or "").count("!"), n),
            "dup_line_ratio": per(dup, len(lines)), "repeat_ratio": per(repeat, n), "digit_ratio": per(digits, chars),
        }

    known = [(i, s, *profile(t)) for i, t, s in rows]
    tune = [(label[i], sc) for i, s, failed, sc in known if i in label and not failed and tuning(i)]
    good = [sc for v, sc in tune if v == 1]
    path = {}
    for rule, grid in quality_rules.GRIDS.items():
        fine = [j for j, cut in enumerate(grid) if sum(sc[rule] > cut for sc in good) <= epsilon / len(quality_rules.GRIDS) * len(good)]
        end = max(fine, default=0)
        path[rule] = [grid[round(end * t / (quality_rules.STEPS - 1))] for t in range(quality_rules.STEPS)]
    over = lambda sc, t: [r for r in path if sc[r] > path[r][t]]
    held = {}
    for i, s, failed, sc in known:
        if label.get(i) == 1 and not failed and not tuning(i):
            held.setdefault(s, []).append(sc)
    held = {s: v for s, v in held.items() if len(v) >= quality_rules.least_labels(epsilon, delta)}
    steps = {}
    for s, v in held.items():
        most = 0
        while most < quality_rules.STEPS and quality_rules.binomial_cdf(sum(bool(over(sc, most)) for sc in v), len(v), epsilon) <= delta / len(held):
            most += 1
        share = lambda y, t: sum(bool(over(sc, t)) for v, sc in tune if v == y) / max(1, sum(v == y for v, _ in tune))
        gains = [round(share(0, t) - share(1, t), 9) for t in range(most)]
        best = [t for t, g in enumerate(gains) if g == max(gains)]
        if best:
            steps[s] = best[len(best) // 2]
    return {i: (failed, sorted(over(sc, steps[s])) if s in steps else []) for i, s, failed, sc in known}, steps


def test_verdicts_against_brute_force(spark):
    rnd = random.Random(14)

    def text(kind):
        words = [f"w{rnd.randint(0, 400)}" if rnd.random() < 0.1 else rnd.choice(["alpha", "Beta", "gamma", "delta", "eps"]) + "abcdefgh"[rnd.randint(0, 7)] * rnd.randint(1, 9) for _ in range(rnd.randint(40, 90))]
        for j in range(len(words)):
            if kind == "#" and rnd.random() < 0.4 or rnd.random() < 0.003:
                words[j] += rnd.choice("#*$")
            if kind == "A" and rnd.random() < 0.7:
                words[j] = words[j].upper()
            if kind == "!" and rnd.random() < 0.5 or rnd.random() < 0.01:
                words[j] += "!"
        if kind == "d":
            words = [w if rnd.random() < 0.5 else str(rnd.randint(0, 10**9)) for w in words]
        if kind == "r":
            words[:30] = words[:6] * 5
        lines = [" ".join(words[j : j + 8]) for j in range(0, len(words), 8)]
        return "\n".join(lines + lines[:1] * (3 if kind == "l" else 0))

    rows = [(i, text(rnd.choice("..........#A!drl")), ["en", "fr", None, "xx"][0 if i % 2 else (1 if i % 4 else (2 if i % 8 else 3))]) for i in range(1800)]
    labels = [(i, int(rnd.random() < 0.97 and not re.search("[#*$] .*[#*$] .*[#*$]", t))) for i, t, _ in rows if i % 5] + [(1, None), (2, 0), (2, 1), (None, 1), (99_999, 1)]
    docs = table(spark, [(i, t, s, "a") for i, t, s in rows])
    tuned = {r[0] for r in docs.where(F.pmod(F.xxhash64(F.lit("tuning"), F.col("doc_id")), F.lit(quality_rules.TUNING_OF)) == 0).select("doc_id").collect()}
    want, steps = slow_judge(rows, labels, tuned.__contains__)
    assert {"en", "fr"} <= set(steps) and "xx" not in steps
    got = quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, label int")).collect()
    assert {r["doc_id"]: (r["base_failed"], sorted(r["rejected_by"])) for r in got} == want
    assert all(r["kept"] == (not r["base_failed"] and not r["rejected_by"]) for r in got)
    assert any(r["rejected_by"] for r in got) and {x for r in got for x in r["rejected_by"]} >= {"symbol_ratio"}


def test_many_strata(spark):
    rows = [(i, f"some words {i} " + "x " * 60, f"junk{i}" if i < 2500 else "en", "a") for i in range(2600)]
    out = quality_rules.judge(table(spark, rows), spark.createDataFrame([(i, 1) for i in range(2600)], "doc_id long, label int"))
    assert out.count() == 2600


def test_rules_reject_junk_and_keep_good(spark):
    rnd = random.Random(4)
    good = [(i, " ".join(f"w{rnd.randint(0, 999)}" for _ in range(80)), "en", "a") for i in range(1000)]
    junk = [(5000 + i, " ".join(f"w{rnd.randint(0, 999)}###" for _ in range(80)), "en", "a") for i in range(50)]
    other = [(9000, " ".join(f"v{i}###" for i in range(80)), "xx", "a")]
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in junk[:20]] + [(7, None), (12, 1)], "doc_id long, label int")
    out = {r["doc_id"]: r for r in quality_rules.judge(table(spark, good + junk + other + [ODD[0], ODD[1]]), labels).collect()}
    assert sum(not out[r[0]]["kept"] for r in good) <= 0.02 * len(good)
    assert not any(out[r[0]]["kept"] for r in junk) and "symbol_ratio" in out[5049]["rejected_by"]
    assert out[9000]["kept"]  # a stratum without labels rejects nothing
    assert not out[1]["kept"] and out[2]["base_failed"]


def test_rules_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert quality_rules.judge(table(spark, []), none).count() == 0
    rows = quality_rules.judge(table(spark, ODD), none).collect()
    assert len(rows) == len(ODD) and all(r["kept"] is not None for r in rows)


# --- 6


def slow_dedup(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or min(held[key(x)]) == i) for i, t in rows}


def test_line_dedup_against_brute_force(spark):
    rnd = random.Random(6)
    lines = ["a long repeated line", " A LONG repeated line\t", "short", "", "ÄÖÜ never folds here", "äöü never folds here", "exactly10!", "nine char", "once only " + "x" * 20]
    rows = [(i, None if i % 17 == 0 else "\n".join(rnd.choice(lines) + rnd.choice(["", "", str(rnd.randint(0, 9))]) for _ in range(rnd.randint(0, 8)))) for i in range(60)]
    out = line_dedup.dedup_lines(table(spark, [(i, t, "en", "a") for i, t in rows]))
    want = slow_dedup(rows)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want
    assert {"pos", "hash", "size", "__id", "n_lines", "n_dropped"} <= set(out.columns)


def test_lines_that_share_64_bits_stay(spark):
    rows = [(1, "one line of text\nsaid by both of them"), (2, "ryugnssg1s b/at/\nsaid by both of them")]
    df = table(spark, [(i, t, "en", "a") for i, t in rows])
    assert df.select(F.xxhash64(F.substring("text", 1, 16))).distinct().count() == 1
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()} == slow_dedup(rows) == {1: rows[0][1], 2: "ryugnssg1s b/at/"}


def test_line_dedup_odd_tables(spark):
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0
    out = line_dedup.dedup_lines(table(spark, ODD)).collect()
    assert len(out) == len(ODD)
    assert {(r["doc_id"], r["text"]) for r in out if r["doc_id"] in (None, 1, 3)} == {(None, "no id at all here"), (None, ""), (1, ""), (3, "one")}


def test_line_dedup_of_a_text_of_many_lines(spark):
    shared = "a line that both of them hold"
    rows = [(i, "\n".join([f"line {i} of number {j} in it" for j in range(200_000)] + [shared])) for i in (1, 2)]
    df = table(spark, [(i, t, "en", "a") for i, t in rows]).select("doc_id", "text").cache()
    df.count()
    began = time.perf_counter()
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(df).collect()}
    took = time.perf_counter() - began
    df.unpersist()
    assert got == {1: (200_001, 0, rows[0][1]), 2: (200_001, 1, rows[1][1][: -len(shared) - 1])}
    assert took < 60  # about 5 s; it was over an hour when every line split the text again


def oracle(spark, query, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = query(spark, SF)
    cur = con.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(cur.fetchall())


def test_line_dedup_query_equals_sql(spark):
    oracle(spark, op6_line_dedup, "op6_line_dedup")


# --- 8


def slow_spans(text):
    rules = [(0, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), (1, r"AKIA[A-Z0-9]+", 0, 20), (2, r"[0-9a-f]+", 0, 24)]
    return sorted((m.start(), k, m.end()) for k, p, g, n in rules for m in re.finditer(p, text or "", re.A) if len(m[g]) >= n)


TEXTS = ["password=hunter22 é token: 'abc' SECRET =  \"long-enough\"", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "f" * 23 + " " + "0" * 24 + "é" + "a1" * 20, "secret=token: abcdef", "apikey:=x api_key = 123456", "", None, "tokentoken=abcdef" * 3]


def test_spans(spark):
    df = table(spark, [(i, t, "en", "a") for i, t in enumerate(TEXTS)] + [ODD[5], ODD[6], (0, TEXTS[0], "en", "a")])
    out = secrets.scan(df, secrets.BASE).collect()
    assert len(out) == len(TEXTS) + 3
    for r in out:
        if r["doc_id"] is not None:
            assert [(f["start"], f["kind"], f["end"]) for f in r["findings"]] == slow_spans(TEXTS[r["doc_id"]]), r["doc_id"]


def test_ledger_scans_each_pair_once(spark, tmp_path):
    at = str(tmp_path / "ledger")
    first = table(spark, [(1, TEXTS[0], "en", "a"), (2, TEXTS[0], "en", "a"), (3, TEXTS[1], "en", "a")])
    secrets.scan(first, secrets.BASE, at).count()
    assert spark.read.parquet(at).count() == 2
    more = first.union(table(spark, [(4, TEXTS[2], "en", "a")]))
    got = {r["doc_id"]: len(r["findings"]) for r in secrets.scan(more, secrets.BASE, at).collect()}
    assert spark.read.parquet(at).count() == 3 and got == {1: 2, 2: 2, 3: 1, 4: 2}
    newer = [secrets.Rule("assign", secrets.BASE[0].pattern, 1, 11, version=2), *secrets.BASE[1:]]
    got = {r["doc_id"]: len(r["findings"]) for r in secrets.scan(more, newer, at).collect()}
    scanned = spark.read.parquet(at).orderBy(F.size("scanned")).collect()
    assert len(scanned) == 6 and [list(r["scanned"]) for r in scanned[:3]] == [["assign@2"]] * 3
    assert got == {1: 1, 2: 1, 3: 1, 4: 2}
    assert secrets.scan(table(spark, []), secrets.BASE, at).count() == 0


def test_long_text_with_many_findings(spark):
    rnd = random.Random(8)
    text = "é".join(rnd.choice(["token=abcdef", "key ", "AKIA" + "Q" * 16, "0" * 24 + " ", "secret: ab, ", "d" * 30]) for _ in range(60_000))
    for t in (text, "token=abcdef" + "é token=abcdef" * (secrets.PART - 1), "token=abcdef" + "é token=abcdef" * secrets.PART):
        r = secrets.scan(table(spark, [(1, t, "en", "a")]), secrets.BASE).first()
        assert [(f["start"], f["kind"], f["end"]) for f in r["findings"]] == slow_spans(t)


def test_old_ledgers_give_findings_of_this_run_only(spark, tmp_path):
    at = str(tmp_path / "ledger")
    secrets.scan(table(spark, [(i, f"token=abcdef{i}", "en", "a") for i in range(9)]), secrets.BASE, at).count()
    got = secrets.scan(table(spark, [(20, "token=abcdef3", "en", "a"), (21, "none", "en", "a"), (22, "token=abcdef3", "en", "a")]), secrets.BASE, at)
    assert sorted((r["doc_id"], len(r["findings"])) for r in got.collect()) == [(20, 1), (21, 0), (22, 1)]


def test_assignments_in_capitals_alone(spark, tmp_path):
    texts = ["PASSWORD=hunter22", "DB_PASSWORD: abcdef1", "PASSWD=abcdef1", "passWord=abcdef1", "passwd=abcdef1", "SECRET\"  : 'abcdef1", "API_KEY=abcdef1", "TOKENS=abcdef1", "KEYS=abcdef1"]
    df, at = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), str(tmp_path / "ledger")
    for r in secrets.scan(df, secrets.BASE).collect():
        assert [(f["start"], f["kind"], f["end"]) for f in r["findings"]] == slow_spans(texts[r["doc_id"]]), texts[r["doc_id"]]
    # a ledger of the rule's first version, which found nothing in these texts, does not hide them
    df.select(F.sha2("text", 256).alias("blob"), F.array(F.lit("assign@1")).alias("scanned"), F.array().cast(f"array<{secrets.FINDING}>").alias("findings")).write.parquet(at)
    assert sum(len(r["findings"]) for r in secrets.scan(df, secrets.BASE, at).collect()) == sum(len(slow_spans(t)) for t in texts) == 7


def test_more_kinds_keep_the_base(spark):
    t = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 10 + " password: hunter22"
    r = secrets.scan(table(spark, [(1, t, "en", "a")])).select(secrets.rendered(F.col("findings"), secrets.RULES).alias("s")).first()
    assert r["s"] == "pem:0:31,forge:32:76,assign:77:95"


def test_secret_query_equals_sql(spark):
    oracle(spark, op8_secret_scan, "op8_secret_scan")


# --- 10


def slow_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    head = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((head[a], head[b]))
                head = {i: x if h == y else h for i, h in head.items()}
    return {i: (len(sets[i]), head[i]) for i in sets}


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("k, percent, seed", [(3, 90, 1), (5, 80, 2), (3, 60, 3)])
def test_join_against_brute_force(spark, monkeypatch, k, percent, seed, hot):
    if hot:  # the ways beyond each bound
        for name, value in (('BROADCAST_IDS', 0), ('PAIRS_A_TASK', 3), ('FIRST_MEMBERS', 2), ('GROWTH', 2)):
            monkeypatch.setattr(jaccard, name, value)
    rnd = random.Random(seed)
    rows, i = [], 0
    for n, copies, edits in ((150, 40, 4), (400, 25, 12), (60, 20, 2), (30, 15, 1), (10, 6, 1), (2, 4, 0)):
        base = [f"w{rnd.randint(0, 500)}" for _ in range(n)]
        for _ in range(copies):
            w = base[:]
            for _ in range(rnd.randint(0, edits)):
                w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 9999)}"
            if rnd.random() < 0.3:
                w += [f"t{rnd.randint(0, 99)}" for _ in range(rnd.randint(1, max(1, n // 12)))]
            rows.append((i := i + 1, " ".join(w).upper() if rnd.random() < 0.2 else " ".join(w)))
    rows += [(i + 1, None), (i + 2, ""), (i + 3, "one"), (i + 4, "One "), (i + 5, "one two")]
    rnd.shuffle(rows)
    want = slow_groups(rows, k, percent)
    got = {r[0]: (r[1], r[2]) for r in jaccard.join_groups(table(spark, [(a, t, "en", "a") for a, t in rows]), k, percent).collect()}
    assert got == want
    assert len({g for _, g in want.values()}) < len(rows) - 20


def test_join_odd_tables(spark):
    assert jaccard.join_groups(table(spark, [])).count() == 0
    out = jaccard.join_groups(table(spark, ODD + [(7, "shared text of one id", "en", "a"), (8, "shared text of one id", "en", "a"), (8, "quite another text here", "en", "a"), (9, "quite another text here", "en", "a")])).collect()
    assert len(out) == len(ODD) + 4
    assert {r["component_id"] for r in out if r["doc_id"] in (7, 8, 9)} == {7}
    assert {r["component_id"] for r in out if r["doc_id"] is None} == {None}


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)] + [(300, 200), (300, 4)]
    got = dict(map(tuple, components.components(spark.createDataFrame(chain + star + [(9, 9)], "a long, b long")).collect()))
    assert got == {i: 100 for i in range(101, 161)} | {i: 4 for i in (5, 300, *range(200, 260))}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hash_is_of_utf8(spark):
    r = op6_line_dedup(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("n_dropped = 0").first()
    assert r["kept_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
