"""Quality rules with risk-controlled thresholds.

Every rule is a score of a document's text (higher: worse) and a grid of cutoffs from lenient to strict. All rules tighten together
along a path of STEPS steps. Labelled documents that pass the base are split by a hash of their ids:

* A TUNING_OF-th shapes the path: a rule's last cutoff is the strictest that at most EPSILON / rules of the good ones exceed.
* The rest is the holdout. For a stratum (the language) with n good documents there, k of which any rule would reject at a step, the hypothesis
  "the rules together reject more than a share EPSILON of good documents here" has the exact p-value P(Binomial(n, EPSILON) <= k). From
  the most lenient step to the strictest, steps are accepted while that p-value stays at or below the level, and the first failure ends the
  walk (fixed-sequence testing needs no further correction within a stratum). The level is DELTA / strata (Bonferroni), so that with
  probability 1 - DELTA all accepted steps of all strata keep the promise at once, and any of them may be used.

Used is the accepted step that parts bad from good tuning documents best (the middle one of those that do so equally well). Strata with too few
labels to accept anything (fewer than log(DELTA) / log(1 - EPSILON) good ones) are not tested and reject nothing beyond the base. What
is promised is the verdict of all rules together, by stratum.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import map_texts

EPSILON, DELTA = 0.02, 0.05
STEPS, TUNING_OF = 20, 4

#: Rules: score column -> cutoffs from lenient to strict; a document is rejected when its score exceeds the cutoff.
GRIDS: dict[str, list[float]] = {
    "symbol_ratio": [x / 20 for x in range(60, 0, -1)],
    "upper_ratio": [x / 50 for x in range(49, 0, -1)],
    "exclaim_ratio": [x / 50 for x in range(60, 0, -1)],
    "dup_line_ratio": [x / 50 for x in range(49, 0, -1)],
    "repeat_ratio": [x / 50 for x in range(49, 0, -1)],
    "digit_ratio": [x / 50 for x in range(49, 0, -1)],
}

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[^\W\d_]")
_DIGIT = re.compile(r"[0-9]")

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OTHERS = ["n_upper", "n_letters", "n_exclaim", "n_lines", "n_digits"]
PROFILE = ", ".join(f"{c} long" for c in COUNTS + OTHERS)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 3 words whose text occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    pair = w[:-1] * len(ids) + w[1:]
    # number the pairs anew before the third word joins, so that keys stay below 2**63 for any text
    _, pair = np.unique(pair, return_inverse=True)
    key = pair[:-1] * len(ids) + w[2:]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[where] > 1
    if not again.any():
        return 0
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : shift + n - 2] |= again
    return int(inside.sum())


def profile(text: str | None) -> tuple[int, ...]:
    """COUNTS and OTHERS of one text; null counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() ends words at ASCII white space only
    lines = text.split("\n")
    seen = Counter(x for x in lines if x.strip(BLANKS))
    letters = len(_LETTER.findall(text))
    return (
        len(words),
        len(text) - sum(text.count(c) for c in BLANKS),
        sum(text.count(c) for c in SYMBOLS),
        sum(seen.values()) - len(seen),
        repeated_words(words),
        len(_UPPER.findall(text)),
        letters,
        text.count("!"),
        sum(seen.values()),
        len(_DIGIT.findall(text)),
    )


def with_profile(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep and the counts of each text, computed from whole texts in Arrow batches."""

    def run(texts: list[str | None]) -> dict[str, pa.Array]:
        rows = [profile(t) for t in texts]
        return {c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(COUNTS + OTHERS)}

    return map_texts(docs, keep, text, PROFILE, run)


def scores() -> dict[str, Column]:
    """The score of each rule from the counts; a document without words scores 0."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_ratio": per("n_symbols", "n_words"),
        "upper_ratio": per("n_upper", "n_letters"),
        "exclaim_ratio": per("n_exclaim", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "digit_ratio": per("n_digits", "word_chars"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed exactly from log terms."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(k + 1)))


def accepted(rejected: list[int], n: int, epsilon: float, level: float) -> int:
    """How many steps, from the first on, fixed-sequence testing accepts; rejected: good documents that each rejects, of n."""
    for step, k in enumerate(rejected):
        if k > epsilon * n or binomial_cdf(k, n, epsilon) > level:
            return step
    return len(rejected)


def least_labels(epsilon: float, delta: float) -> int:
    """Good documents below which no step can be accepted, even if none of them is rejected."""
    return math.ceil(math.log(delta) / math.log1p(-epsilon))


def path_of(good: dict[str, Counter], n: int, epsilon: float = EPSILON) -> dict[str, list[float]]:
    """The cutoffs of each rule by step. good: for each rule, how many of n tuning documents exceed just so many cutoffs of its grid
    (a document that exceeds j of them exceeds the last j, the strict ones)."""
    path = {}
    for rule, grid in GRIDS.items():
        over = [sum(c for j, c in good.get(rule, {}).items() if j >= len(grid) - i) for i in range(len(grid))]
        end = max((i for i, k in enumerate(over) if k <= epsilon / len(GRIDS) * n), default=0)
        path[rule] = [grid[round(end * t / (STEPS - 1))] for t in range(STEPS)]
    return path


def best_step(most: int, good: Counter, bad: Counter) -> int:
    """Of steps 0 to most - 1, the middle one of those that part bad from good best. good, bad: tuning documents by first rejecting step."""
    share = lambda c, t: sum(v for first, v in c.items() if first <= t) / max(1, sum(c.values()))
    gains = [share(bad, t) - share(good, t) for t in range(most)]
    best = [t for t, g in enumerate(gains) if g >= max(gains) - 1e-12]
    return best[len(best) // 2]


def _count(cuts: list[float], test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), test))


def _first_steps(path: dict[str, list[float]]) -> dict[str, Column]:
    """For each rule, the first step that rejects a document; STEPS where none does."""
    return {rule: _count(path[rule], lambda cut: cut >= score) for rule, score in scores().items()}  # noqa: B023


def certify(profiled: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", epsilon: float = EPSILON, delta: float = DELTA, stage=None) -> tuple[dict[str, list[float]], dict[str | None, int], dict[str | None, int]]:
    """The path, and by tested stratum the number of accepted steps and the step in use (strata that accept none are in the first only).

    profiled: doc_id, stratum and counts. labels: doc_id and label (1 good, 0 bad; null is no label; of repeated
    labels the highest counts). Base failures don't count: what the base rejects is no decision of a cutoff. Rows that repeat an id are one
    labelled document. Two aggregations over the labelled documents give everything; of their results the driver gets a row for each
    rule and grid place, and for each tested stratum (at least least_labels good documents in each), label and step.
    """
    labels = labels.where("label is not null").groupBy(F.col(doc_id)).agg(F.max("label").alias("__label"))
    rows = profiled.where(~base_failed()).join(labels, doc_id).groupBy(F.col(doc_id).alias("__id")).agg(F.max("__label").alias("__label"), F.max(F.struct(F.col(stratum).alias("stratum"), *COUNTS, *OTHERS)).alias("__row"))
    tuning = F.pmod(F.xxhash64(F.lit("tuning"), F.col("__id")), F.lit(TUNING_OF)) == 0
    held = rows.select("__label", tuning.alias("__tuning"), "__row.*")
    held = stage(held, "labelled") if stage else held
    over = [
        F.struct(F.lit(rule).alias("rule"), _count(GRIDS[rule], lambda cut: score > cut).alias("over"))  # noqa: B023
        for rule, score in scores().items()
    ]
    good: dict[str, Counter] = {rule: Counter() for rule in GRIDS}
    for r in held.where("__tuning and __label = 1").select(F.inline(F.array(*over))).groupBy("rule", "over").count().collect():
        good[r["rule"]][r["over"]] += r["count"]
    path = path_of(good, sum(good[next(iter(GRIDS))].values()), epsilon)

    first = held.select("stratum", "__tuning", "__label", F.least(*_first_steps(path).values()).alias("first"))
    pooled: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for r in first.where("__tuning").groupBy("__label", "first").count().collect():
        pooled[1 if r["__label"] == 1 else 0][r["first"]] += r["count"]
    tests = first.where("not __tuning and __label = 1")
    enough = tests.groupBy("stratum").count().where(F.col("count") >= least_labels(epsilon, delta)).select(F.col("stratum").alias("tested"))
    counts: dict[str | None, Counter] = {}
    for r in tests.join(enough, F.col("stratum").eqNullSafe(F.col("tested")), "left_semi").groupBy("stratum", "first").count().collect():
        counts.setdefault(r["stratum"], Counter())[r["first"]] += r["count"]
    found = {
        value: accepted([sum(c for f, c in firsts.items() if f <= t) for t in range(STEPS)], sum(firsts.values()), epsilon, delta / len(counts))
        for value, firsts in counts.items()
    }
    return path, found, {value: best_step(most, pooled[1], pooled[0]) for value, most in found.items() if most}


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", epsilon: float = EPSILON, delta: float = DELTA, stage=None, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, stratum, the columns keep, the counts, base_failed, rejected_by (array), kept.

    labels: doc_id and label (1 good, 0 bad; null is no label). Null and empty texts have no words and fail
    the base; long texts are counted whole. Null ids get a verdict like any other row and are never labelled. Rows that repeat an id, and
    ties, each get the verdict of their own text and stratum. A null stratum is a stratum; there may be any number of strata. A
    score that equals a cutoff does not exceed it. Other columns of docs are not read. An empty table gives no rows, and without labels only
    the base rejects.
    stage(df, name) writes the profile once, so that texts are read once; without it they are read again for each use.
    """
    p = with_profile(docs, [doc_id, stratum, *(keep or [])], text)
    p = stage(p, "profile") if stage else p
    path, _, chosen = certify(p, labels, stratum, doc_id, epsilon, delta, stage)
    # a row for each stratum with a step; Spark broadcasts it by its size
    kind = p.schema[stratum].dataType.simpleString()
    steps = p.sparkSession.createDataFrame(list(chosen.items()), f"__stratum {kind}, __step int")
    judged = p.join(steps, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    by = [F.when(first <= F.col("__step"), F.lit(rule)) for rule, first in _first_steps(path).items()]
    judged = judged.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.array_compact(F.array(*by))).drop("__stratum", "__step")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
