"""Queries of operators 11 to 13 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import collocations, divergence, url_templates
from barloom.llm.common import read

#: Rules of the registered URL filter: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT lang, source, coalesce(v, 0)::HUGEINT AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY 1, 2),
h AS (SELECT lang, source, v, coalesce(total, 0)::HUGEINT AS total FROM g LEFT JOIN s USING (lang, source)),
p AS (SELECT h.lang, h.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (total + 2 * v)) AS p
      FROM h JOIN kept k USING (lang) LEFT JOIN c ON c.lang = h.lang AND c.source = h.source AND c.term = k.term),
w AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n)::HUGEINT + 2) // (any_value(l.total) + 2 * any_value(l.v)) AS q
      FROM p JOIN (SELECT lang, sum(total)::HUGEINT AS total, any_value(v) AS v FROM h GROUP BY 1) l USING (lang) GROUP BY 1, 2),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN w USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= 10
"""


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "template", "labelled", "purity")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, unnest(w) AS phrase, 1 AS k FROM w
      UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM w
      UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM w),
f AS (SELECT lang, phrase, k, count(*) AS n FROM g GROUP BY 1, 2, 3),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
x AS (SELECT lang, phrase, a, w, k AS size, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT x.lang, x.phrase, x.a, cut, l.n AS l, r.n AS r, 1000000::HUGEINT * a * a // (l.n::HUGEINT * r.n) AS score FROM x
      JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[cut+1:size], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY 1, 2),
o AS (SELECT b.* FROM b LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN t USING (lang) QUALIFY rank <= 2000
"""

QUERIES = {"op11_source_divergence": op11_source_divergence, "op12_url_filter": op12_url_filter, "op13_collocations": op13_collocations}
SQL = {"op11_source_divergence": OP11_SQL, "op13_collocations": OP13_SQL}
