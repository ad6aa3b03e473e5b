"""Operators 11, 12 and 13 against brute force, and on odd tables."""

import random
import re
from collections import Counter
from math import sqrt

import duckdb
import numpy as np
import pytest

from barloom.llm import collocations, divergence, url_templates
from barloom.llm.queries import SQL
from barloom.llm.queries.audits import RULES, op11_source_divergence, op12_url_filter, op13_collocations

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, docs long, phrase string, k int, rank int"


def table(spark, rows):
    """documents (text, lang, source) with extra columns whose names could clash."""
    return spark.createDataFrame([(i, t, lang, s, "x", 1, 2, "y", 3, 4) for i, (t, lang, s) in enumerate(rows)], SCHEMA)


ODD = [(None, None, None), ("", "en", ""), ("one", "en", "a"), ("one", "en", "a"), ("word " * 50_000, None, "b"), ("É é É! x\x00y\x1fz\xa0w", "en", None)]


def equals_sql(spark, query, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = query(spark, SF)
    cur = con.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got, want = sorted(map(tuple, df.select(*cols).collect())), sorted(cur.fetchall())
    assert got == want and want


# --- 11


def slow_audit(rows, least, first):
    docs = [((lang or ""), (s or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for t, lang, s in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        v = len(kept)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * v)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s, c in counts.items():
            pairs = sorted((-sum(f(p(c, t), p(d, t)) for t in kept), r.encode(), r) for r, d in counts.items() if r != s)
            out |= {(lang, s, "pair", r, -x, i) for i, (x, _, r) in enumerate(pairs, 1)}
            terms = sorted((-f(p(c, t), p(whole, t)), t.encode(), t) for t in kept if c[t] and p(c, t) > p(whole, t))
            out |= {(lang, s, "term", t, -x, i) for i, (x, _, t) in enumerate(terms[:first], 1)}
    return out


def some_texts(seed, n=150):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["ÄB", "äb", "É", "日本", "X9y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(" ".join(rnd.choices(words, weights, k=rnd.randint(0, 40))), rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "B", "ä", None])) for _ in range(n)]


@pytest.mark.parametrize("bits", [64, 3])
def test_audit_against_brute_force(spark, bits):
    rows = some_texts(11)
    got = divergence.audit(table(spark, rows).repartition(5), least_docs=6, first=4, digest_bits=bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == slow_audit(rows, 6, 4)


def test_audit_in_many_blocks_and_sides(spark, monkeypatch):
    rows = [(t, "en", f"s{i % 7}") for i, (t, _, _) in enumerate(some_texts(12, 120))]
    monkeypatch.setattr(divergence, "SIDE", 3)
    monkeypatch.setattr(divergence, "CELLS", 40)
    assert {tuple(r) for r in divergence.audit(table(spark, rows), least_docs=4).collect()} == slow_audit(rows, 4, 10)


def test_chunks_add_up_in_parts(monkeypatch):
    monkeypatch.setattr(divergence, "TOKENS", 50)
    monkeypatch.setattr(divergence, "SLICE", 16)
    rows, chunk = some_texts(13, 60), divergence._Chunk()
    for t, lang, s in rows:
        chunk.add(lang or "", hash(s), t.encode())
    got = {(r["lang"], r["term"].decode()): (r["docs"], {c["group"]: c["n"] for c in r["cells"]}) for r in chunk.out((1 << 64) - 1).to_pylist()}
    docs, cells = Counter(), {}
    for t, lang, s in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER))
        docs.update((lang or "", w) for w in set(words))
        for w in words:
            cells.setdefault((lang or "", w), Counter())[hash(s)] += 1
    assert got == {k: (n, dict(cells[k])) for k, n in docs.items()}


@pytest.mark.parametrize("bits", [64, 4])
def test_audit_joins_many_digests_by_shuffle(spark, monkeypatch, bits):
    monkeypatch.setattr(divergence, "BROADCAST_DIGESTS", 0)
    rows = some_texts(14, 80)
    assert {tuple(r) for r in divergence.audit(table(spark, rows), least_docs=5, digest_bits=bits).collect()} == slow_audit(rows, 5, 10)


def test_audit_odd_tables(spark):
    assert divergence.audit(table(spark, [])).count() == 0
    assert {tuple(r) for r in divergence.audit(table(spark, ODD)).collect()} == slow_audit(ODD, 10, 10)
    assert {tuple(r) for r in divergence.audit(table(spark, ODD), least_docs=1).collect()} == slow_audit(ODD, 1, 10)
    assert {tuple(r) for r in divergence.audit(table(spark, [("a b", "en", "s")] * 12)).collect()} == slow_audit([("a b", "en", "s")] * 12, 10, 10) == set()


def test_audit_is_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n = 7 * 10**15 + 3
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(9 * 10**15), F.lit(10**9)).alias("p"), divergence.diverge(F.lit(10**9 + 1), F.lit(1)).alias("f")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (9 * 10**15 + 2 * 10**9) and row["f"] == (10**9) ** 2 // (10**9 + 2)


def test_audit_query_equals_sql(spark):
    equals_sql(spark, op11_source_divergence, "op11_source_divergence")


# --- 12


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    after = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", after)
    return m[1].translate(LOWER), m[2]


def rule_for(host, path, rules):
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


def slow_filter(urls, rules, s):
    """Verdicts by the definition: a tree of dictionaries for each host, then groups from the leaves up."""
    paths = {cut(u) for u in urls}
    lab = {k: (rule_for(*k, rules)[1] is not None, rule_for(*k, rules)[1] == "block") for k in paths}
    parts = {}
    for h, p in paths:
        bare = re.sub("^/", "", p)
        parts[h, p] = [*(bare.split("/", s.levels - 1)), "??"]
    token = {k: [] for k in paths}
    for level in range(s.levels + 1):
        nodes = {}
        for k in paths:
            if level < len(parts[k]):
                nodes.setdefault((k[0], tuple(token[k])), []).append(k)
        for keys in nodes.values():
            need = max(2, s.share * len(keys))
            seg = {k: parts[k][level] for k in keys}
            literal = {x for x, n in Counter(seg.values()).items() if n >= need or x == "??"}
            shape = lambda x: re.sub("[0-9]+", "#", x)
            shapes = {x for x, n in Counter(shape(x) for x in seg.values() if x not in literal).items() if n >= need}
            for k in keys:
                x = seg[k]
                token[k].append(x if x in literal else shape(x) if shape(x) in shapes else "?")
    base = sum(b for _, b in lab.values()) / max(1, sum(x for x, _ in lab.values()))
    out = {}
    for host in {h for h, _ in paths}:
        leaves = {}
        for k in paths:
            if k[0] == host:
                leaves.setdefault(tuple(token[k]), []).append(k)
        closed = []

        def groups_of(prefix, leaves=leaves, closed=closed):
            """The branch of a node (keys), or None if its children fell apart."""
            if prefix in leaves and prefix[-1:] == ("??",):
                return leaves[prefix]
            kids = sorted({t[len(prefix)] for t in leaves if t[: len(prefix)] == prefix and len(t) > len(prefix)})
            them = [groups_of((*prefix, x)) for x in kids]
            whole = all(b is not None for b in them)
            tested, few, none = [], [], []
            count = lambda b: (sum(lab[k][0] for k in b), sum(lab[k][1] for k in b))
            first = lambda b: sorted(tuple(token[k]) for k in b)[0]
            for b in sorted((b for b in them if b is not None), key=lambda b: (count(b)[1] / max(1, count(b)[0]), first(b))):
                n, bad = count(b)
                if n >= s.least:
                    m, worse = count(tested[-1]) if tested else (0, 0)
                    if tested:
                        pooled = (bad + worse) / (n + m)
                        if abs(bad / n - worse / m) <= s.z * sqrt(pooled * (1 - pooled) * (1 / m + 1 / n)):
                            tested[-1] = tested[-1] + b
                            continue
                    tested.append(b)
                else:
                    (few if n else none).extend(b)
            groups = [*tested, *([few] if few else []), *([none] if none else [])]
            if whole and len(groups) == 1:
                return groups[0]
            closed.extend(groups)
            return None

        top = groups_of(())
        for g in [*closed, *([top] if top is not None else [])]:
            n, bad = sum(lab[k][0] for k in g), sum(lab[k][1] for k in g)
            purity = (bad + s.prior * base) / (n + s.prior)
            for k in g:
                out[k] = (n, purity, "block" if n >= s.least and purity >= s.reject else "allow")
    return {u: (*cut(u), *verdict_of(cut(u), rules, out)) for u in urls}


def verdict_of(key, rules, out):
    rule, verdict = rule_for(*key, rules)
    n, purity, learned = out[key]
    return rule, verdict or learned, n, round(purity, 9)


def some_urls(seed, n):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        host = rnd.choice(["a.com", "WWW.example.com", "x.net", "x.net", "x.net", "b.org", "b.org"])
        lang = rnd.choice(["en", "es", "fr", "de"])
        tail = rnd.choice([f"{rnd.randint(1, 999)}.html", f"u{rnd.randint(1, 99)}/photos", f"{rnd.choice('pqrstuvw')}{rnd.choice('xyz')}/a//b", "", "long/" * 12, "odd?"])
        sub = rnd.choice(["", "", f"shop/{lang}/"])
        out.append(f"http://{host}/{sub}{lang}/{tail}" + rnd.choice(["", "?q=1", "#top"]))
    return [*out, None, "no scheme", "ftp://", "http://h.com", "http://h.com?x=/en/", "http://h.com/", "x://y://z/en/1", "http://x.net/*/??"]


@pytest.mark.parametrize("settings", [url_templates.Settings(), url_templates.Settings(share=0.1, levels=3, least=5, z=0.5, prior=1.0, reject=0.6)])
def test_url_filter_against_brute_force(spark, settings):
    rules = [*RULES, ("b.org", "/shop/es", "block"), ("b.org", "/shop/en", "allow"), ("b.org", "/fr/u", "block"), ("b.org", "/fr/1", "allow"), *[("b.org", f"/es/{i}", "block") for i in range(1, 6)], *[("b.org", f"/es/u{i}", "block") for i in range(1, 8)]]
    urls = some_urls(3, 2500)
    want = slow_filter(urls, rules, settings)
    pages = spark.createDataFrame([(i, u, "h", "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, template string, lab int")
    out = url_templates.judge(pages, rules, settings=settings).collect()
    assert len(out) == len(urls)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["labelled"], round(r["purity"], 9)) == want[urls[r["page_id"]]], urls[r["page_id"]]
    if settings.least == 5:
        assert {"allow", "block"} == {r["verdict"] for r in out if r["rule"] is None}


def test_learned_rejection_spares_unlabelled_paths(spark):
    urls = [f"http://h.org/spam/{i}" for i in range(60)] + [f"http://h.org/news/{i}" for i in range(60)] + [f"http://h.org/spam/{i}.html" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(f"http://h.org/spam/{i}", True) for i in range(40)] + [("http://h.org/other", False)], "url string, bad boolean")
    got = {r["page_id"]: r for r in url_templates.judge(pages, [], labels).collect()}
    assert {got[i]["verdict"] for i in range(60)} == {"block"} and {got[i]["verdict"] for i in range(60, 180)} == {"allow"}
    assert got[0]["template"] == "/spam/#" and got[60]["template"] == "/news/#"


def test_url_filter_odd_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_templates.judge(none, RULES).count() == 0
    odd = spark.createDataFrame([(None, None), (None, None), (1, "a://B.com/x"), (1, "a://B.com/x"), (2, "a://b.net/es/" + "y/" * 20_000)], "page_id long, url string")
    got = sorted((str(r["page_id"]), r["host"], r["path"][:6], r["rule"], r["verdict"]) for r in url_templates.judge(odd, RULES).collect())
    assert got == [("1", "b.com", "/x", "com/", "allow")] * 2 + [("2", "b.net", "/es/y/", "net/es/", "block")] + [("None", "", "", None, "allow")] * 2


def test_url_filter_query(spark):
    out = op12_url_filter(spark, SF)
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    want = slow_filter(list(urls.values()), RULES, url_templates.Settings())
    rows = out.collect()
    assert len(rows) == len(urls)
    assert all((r["host"], r["path"], r["rule"], r["verdict"]) == want[urls[r["page_id"]]][:4] for r in rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 13


def slow_mine(rows, longest, least, percent, first):
    out = set()
    for lang in {x[1] or "und" for x in rows}:
        counts = Counter()
        for t, of, *_ in rows:
            if (of or "und") == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    counts.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        total = sum(n for p, n in counts.items() if len(p) == 1)
        cand = {p: n for p, n in counts.items() if len(p) > 1 and n >= least}
        inside = Counter()
        for p, n in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], n)
        rows_ = []
        for p, a in cand.items():
            if 100 * inside[p] >= percent * a and inside[p]:
                continue
            cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            rows_.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out |= {(lang, i, p.decode(), -a, left, right, total, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:first], 1)}
    return out


def phrases(seed, n=200):
    rnd = random.Random(seed)
    words = "the New york city of of a state é\xa0x \x1cfs b".split(" ") + ["York", "A"]
    share = [" ".join(rnd.choices(words, k=60)) for _ in range(3)]
    return [((rnd.choice([*share, ""]) + rnd.choice([" ", ". ", "\n", "\r\n", ",", "\t"]) + " ".join(rnd.choices(words, k=rnd.randint(0, 30)))), rnd.choice(["en", "en", None, "de"]), "s") for _ in range(n)]


@pytest.mark.parametrize(("longest", "every"), [(3, 24), (3, 1), (2, 3), (5, 7), (4, 10**9)])
def test_collocations_against_brute_force(spark, longest, every):
    rows = phrases(longest)
    got = collocations.mine(table(spark, rows).repartition(4), longest=longest, least=12, first=60, every=every)
    assert {tuple(r) for r in got.collect()} == slow_mine(rows, longest, 12, 50, 60)


@pytest.mark.parametrize(("longest", "bound"), [(3, 0), (5, 0), (2, 0), (5, 30)])
def test_collocations_deal_many_digests_by_shuffle(spark, monkeypatch, longest, bound):
    monkeypatch.setattr(collocations, "BROADCAST_DIGESTS", bound)
    monkeypatch.setattr(collocations, "BATCH_CHUNKS", 20)
    rows = phrases(longest + 10)
    assert {tuple(r) for r in collocations.mine(table(spark, rows), longest=longest, least=9).collect()} == slow_mine(rows, longest, 9, 50, 2000)


def test_chunks_count_once_and_repeat(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LONGEST_CHUNK", 7)
    rows = phrases(9)
    docs = table(spark, rows).selectExpr("lang", "cast(text as binary) text").fillna("und")
    chunks = collocations.parse(docs, 3).collect()
    words = sum(len(collocations.tokens(t.encode())) for t, *_ in rows)
    assert sum(r["n"] * (len(r["chunk"].split(b" ")) - 2) for r in chunks) == words  # each token belongs to one chunk
    assert np.diff(collocations.chunk_bounds([b"a"] * 100, 2)).max() <= 7
    assert {tuple(r) for r in collocations.mine(table(spark, rows)).collect()} == slow_mine(rows, 3, 10, 50, 2000)


def test_shared_passages_share_chunks():
    rnd = random.Random(1)
    shared = [f"w{rnd.randint(0, 500)}".encode() for _ in range(2000)]
    one, two = ([f"{c}{rnd.randint(0, 500)}".encode() for _ in range(777)] + shared for c in "xy")
    ends = [collocations.chunk_bounds(w, 2) for w in (one, two)]
    chunks = [{tuple(w[a : b + 2]) for a, b in zip(e[:-1], e[1:], strict=True)} for w, e in zip((one, two), ends, strict=True)]
    assert sum(len(c) - 2 for c in chunks[0] & chunks[1]) > 1600
    assert 40 < np.diff(ends[0]).mean() < 110


def test_collocations_odd_tables(spark):
    assert collocations.mine(table(spark, [])).count() == 0
    got = {tuple(r) for r in collocations.mine(table(spark, ODD)).collect()}
    assert got == slow_mine(ODD, 3, 10, 50, 2000) and got
    blanks = [(" \t . ,", "en", "s"), ("\n" * 500, "en", "s")]
    assert collocations.mine(table(spark, blanks)).count() == 0


def test_score_is_exact(spark):
    from pyspark.sql import functions as F

    a, left, right = 10**15 + 7, 3 * 10**15 + 11, 2 * 10**15 + 1
    assert spark.range(1).select(collocations.score(F.lit(a), F.lit(left), F.lit(right)).alias("x")).first()["x"] == 10**6 * a * a // (left * right)


def test_collocations_query_equals_sql(spark):
    equals_sql(spark, op13_collocations, "op13_collocations")
