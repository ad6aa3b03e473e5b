"""Queries of operators 1, 3, 6 and 8: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import line_dedup, mixing, quality_rules, secrets
from barloom.llm.common import read, stage


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(read(spark, sf_dir, "documents"))
    return m.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("copies") * F.col("__size")).alias("taken"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    out = quality_rules.judge(read(spark, sf_dir, "documents"), labels, stage=stage)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT k.doc_id, k.pos, k.line, h.keeper IS NOT NULL AND h.keeper <> k.doc_id AS dropped FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(read(spark, sf_dir, "documents"))
    number = lambda i: F.size(F.filter("findings", lambda f: f["kind"] == i)).cast("long")
    base = {r.kind for r in secrets.BASE}
    return out.select(
        "doc_id",
        *[number(i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)],
        F.sha2(secrets.rendered(F.col("findings"), secrets.RULES, base), 256).alias("base_sha256"),
        secrets.rendered(F.col("findings"), secrets.RULES).alias("spans"),
    )


def _op8_sql() -> str:
    # DuckDB's engine folds case beyond ASCII, so both cases of each letter are written out
    def both(word: str) -> str:
        return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)

    words = "|".join(both(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = f"({words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    kinds = [("assign", assign, 2, 6)] + [(r.kind, r.pattern, 0, r.least) for r in secrets.RULES[1:]]
    parts = []
    for i, (kind, pattern, group, least) in enumerate(kinds):
        parts.append(
            f"SELECT doc_id, {i} AS kind, '{kind}' AS name, "
            f"list_sum([length(x) for x in gaps[1:j]])::BIGINT + coalesce(list_sum([length(x) for x in found[1:j-1]]), 0)::BIGINT AS s, "
            f"length(found[j]) AS n, length(told[j]) AS g, {least} AS least FROM ("
            f"SELECT doc_id, gaps, found, told, unnest(range(1, len(found) + 1)) AS j FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, "
            f"regexp_extract_all(text, '{pattern}', 0) AS found, regexp_extract_all(text, '{pattern}', {group}) AS told FROM d))"
            .replace("FROM d)", "FROM d WHERE regexp_matches(text, '[0-9a-f]{24}'))" if kind == "hex" else "FROM d)")
        )
    found = " UNION ALL ".join(parts)
    span = "name || ':' || s || ':' || (s + n)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT *, {span} AS span FROM ({found}) WHERE g >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
      string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


QUERIES = {"op1_mix_sources": op1_mix_sources, "op3_quality_rules": op3_quality_rules, "op6_line_dedup": op6_line_dedup, "op8_secret_scan": op8_secret_scan}
SQL = {"op6_line_dedup": OP6_SQL, "op8_secret_scan": _op8_sql()}
