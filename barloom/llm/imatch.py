"""I-Match fingerprints: hashes of the terms in a band of inverse document frequency.

A document's terms are its distinct words (A-Z lower-cased). Terms that stand in at least LOW and at most HIGH of
all documents form the lexicon: rarer ones (slips, names of one document) and very common ones say little
about sameness. The kept terms are sorted and hashed once for each of several random subsets of the lexicon, which bits of a term's hash
decide. Subsets come in LEVELS of falling size, each a part of one a level above: 4 of a quarter of the lexicon, then 16 each of a
16th, a 64th, a 256th and a 1024th. A fingerprint is the list of these hashes, null for subsets that hold none of a document's terms. The
likeness of two is the share of subsets that agree among those that hold a term of either, at the finest level where at least half
of the subsets do: there a subset holds a term or two of either text, so that an edit of half a text leaves some subsets as they
were, for short and long texts alike, while other texts hardly agree anywhere.

The lexicon has at most (mean distinct terms of a document) / LOW terms whatever the number of documents; it is
broadcast behind a check of its size and joined by shuffle beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, stage, stretch

LOW, HIGH = 5e-4, 0.1
#: Subsets of each level, largest first; each level's are a quarter of those above.
LEVELS = [4, 16, 16, 16, 16]
#: The lexicon is broadcast up to so many terms (about 32 bytes each in memory).
BROADCAST_TERMS = 1_000_000
#: Rows of one stretch of ids, within which a document finds the next.
STRETCH = 1_000


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's words."""
    words = F.split(ascii_lower(text), r"[\x20\x09-\x0D]+", -1)
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """The terms (hashes) whose share of all documents lies in the band; one at least must hold it."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.explode(terms(body)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.count()
    return stage(found.where((F.col("df") >= max(1, low * total)) & (F.col("df") <= max(1, high * total))).select("term"), "lexicon")


def with_hashes(df: DataFrame, arrays: dict[str, tuple[Column, str]]) -> DataFrame:
    """Adds, for each column of sorted kept terms, its fingerprint (array<long>): arrays has a hash of the whole text and the name to
    give. Texts without any lexicon term equal only themselves: the first place has the whole text's hash then, and null otherwise."""

    def bits(level: int, value: int):
        return lambda h: F.shiftrightunsigned(h, 2 * level).bitwiseAND(3) == value

    # one column a level: Spark computes each once, as the next level and the hashes both refer to it
    names = {c: [f"__{i}_{n}" for n in range(len(LEVELS))] for i, c in enumerate(arrays)}
    for n in range(len(LEVELS)):
        split = lambda a: F.array(*[F.filter(a, bits(n, v)) for v in range(4)])  # noqa: B023, E731
        step = {}
        for c, made in names.items():
            if n == 0:
                step[made[n]] = split(F.col(c))
            elif LEVELS[n] == 4 * LEVELS[n - 1]:
                step[made[n]] = F.flatten(F.transform(F.col(made[n - 1]), split))
            else:
                step[made[n]] = F.transform(F.col(made[n - 1]), lambda a: F.filter(a, bits(n, 0)))  # noqa: B023
        df = df.withColumns(step)
    for c, (whole, out) in arrays.items():
        first = F.array(F.when(F.size(c) == 0, whole))
        df = df.withColumn(out, F.concat(first, F.transform(F.concat(*names[c]), lambda a: F.when(F.size(a) > 0, F.xxhash64(a)))))
    return df.drop(*[x for made in names.values() for x in made])


def rendered(fp: Column) -> Column:
    """Hexadecimal digits of all hashes (their lower halves), joined by "-"; nothing stands for null."""
    return F.array_join(F.transform(fp, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h.bitwiseAND(0xFFFFFFFF))), 8, "0"), F.lit(""))), "-")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1. Texts without lexicon terms are alike if they are equal."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), 0).when(x.eqNullSafe(y), 2).otherwise(1))
    out, at = F.when(F.get(a, F.lit(0)).isNotNull() | F.get(b, F.lit(0)).isNotNull(), F.get(a, F.lit(0)).eqNullSafe(F.get(b, F.lit(0))).cast("double")), 2
    levels = []
    for n in LEVELS:
        levels.append((n, F.slice(both, at, n)))
        at += n
    count = lambda part, least: F.size(F.filter(part, lambda x: x >= least))
    for n, part in reversed(levels):
        out = out.when(2 * count(part, 1) >= (n if n != LEVELS[0] else 0), count(part, 2) / F.greatest(count(part, 1), F.lit(1)))
    return out


def fingerprints(docs: DataFrame, lex: DataFrame | None = None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns keep (default: doc_id) of every row and fingerprint (array<long>). Equal texts have equal ones.

    Null texts count as empty; long texts are read whole. Rows are independent: null ids, ties and repeats each get their fingerprint. Columns that
    are not in keep are not read, whatever their names; an empty table gives no rows.
    """
    keep = keep or ["doc_id"]
    lex = lexicon(docs, text) if lex is None else lex
    body = F.coalesce(F.col(text), F.lit(""))
    head = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.xxhash64(body).alias("whole"))
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), head.alias("__head"), terms(body).alias("__terms"))
    got = _kept(rows, ["__row"], {"__terms": "__kept"}, lex)
    got = with_hashes(got, {"__kept": (F.col("__head.whole"), "__fp")})
    return got.select(*[F.col(f"__head.k{i}").alias(c) for i, c in enumerate(keep)], F.col("__fp").alias("fingerprint"))


def _kept(rows: DataFrame, key: list[str], arrays: dict[str, str], lex: DataFrame) -> DataFrame:
    """key, __head and, for each array of terms, the sorted ones that the lexicon has.

    Rows must be distinct by key; if they are already partitioned by (part of) it, nothing is shuffled.
    """
    none = F.lit(None).cast(rows.schema["__head"].dataType)
    item = lambda kind, term, head: F.struct(F.lit(kind).alias("kind"), term.alias("term"), head.alias("head"))
    parts = [F.array(item(-1, F.lit(None).cast("long"), F.col("__head")))]
    for i, c in enumerate(arrays):
        parts.append(F.transform(F.col(c), _tagged(i, none)))
    flat = rows.select(*key, F.inline(F.concat(*parts)))
    held = lex.select(F.col("term").alias("__term"))
    if held.count() <= BROADCAST_TERMS:
        held = F.broadcast(held)
    flat = flat.join(held, F.col("term") == F.col("__term"), "left").where("__term is not null or kind = -1")
    return flat.groupBy(*key).agg(
        F.first("head", ignorenulls=True).alias("__head"),
        *[F.array_sort(F.collect_set(F.when(F.col("kind") == i, F.col("term")))).alias(out) for i, out in enumerate(arrays.values())],
    )


def _tagged(kind: int, none: Column):
    return lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term"), none.alias("head"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in stretches of ids with the text that follows: __at, __nth, __tail, __id, __body, __next.

    Texts move once, to their stretch. The first row of a stretch is also the tail of the one before (of the last
    one, for the first), so that no stretch needs another. Null ids come first; rows that repeat an id follow
    each other by their texts' hashes. Stretches are even whatever the ids are.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__body"))
    src = src.withColumn("__hash", F.xxhash64("__body"))
    src = src.withColumn("__at", stretch(src.select("__id", "__hash"), STRETCH))
    # the stretches themselves are a thousandth of the rows
    starts = src.groupBy("__at").agg(F.min(F.struct("__id", "__hash")).alias("__first"))
    order = Window.orderBy("__at")
    before = F.coalesce(F.lag("__at").over(order), F.last("__at").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    starts = stage(starts.select("__first", F.col("__at").alias("__of"), before.alias("__before")), "starts")
    tails = src.join(starts, F.col("__id").eqNullSafe(F.col("__first.__id")) & (F.col("__hash") == F.col("__first.__hash")) & (F.col("__at") == F.col("__of")))
    rows = src.withColumn("__tail", F.lit(0)).unionByName(tails.select("__id", "__body", "__hash", F.col("__before").alias("__at"), F.lit(1).alias("__tail")))
    by = Window.partitionBy("__at").orderBy("__tail", F.col("__id").asc_nulls_first(), "__hash")
    return rows.select("__at", F.row_number().over(by).alias("__nth"), "__tail", "__id", "__body", F.lead("__body").over(by).alias("__next"))


def edited(body: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by as many first ones of the following text."""
    n = F.char_length(body)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(body, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness and that to the next document's.

    The next document is that of the next greater id, after the last the first. doc_id holds whole numbers, or text of such; other text is an
    error. Null ids come first, and rows that share an id (or have none) follow each other by a hash of their texts; every row gets a row. Null
    texts count as empty; long texts are read whole. A table of one row is its own next; an empty one gives no rows. Other columns are not read.
    """
    lex = lexicon(docs, text)
    rows = with_next(docs, doc_id, text)
    changed = edited(F.col("__body"), F.col("__next"))
    real = F.col("__tail") == 0
    head = F.struct(
        "__id", "__tail", F.char_length("__body").cast("long").alias("n"), F.xxhash64("__body").alias("whole"),
        F.when(real, F.sha2(changed, 256)).alias("sha"), F.xxhash64(changed).alias("changed"),
    )
    both = rows.select("__at", "__nth", head.alias("__head"), terms(F.col("__body")).alias("__terms"), F.when(real, terms(changed)).otherwise(F.array().cast("array<long>")).alias("__others"))
    got = _kept(both, ["__at", "__nth"], {"__terms": "__kept", "__others": "__changed"}, lex)
    got = with_hashes(got, {"__kept": (F.col("__head.whole"), "fp"), "__changed": (F.col("__head.changed"), "edited_fp")}).select("__at", "__nth", "__head", "fp", "edited_fp")
    following = F.lead("fp").over(Window.partitionBy("__at").orderBy("__nth"))
    out = got.withColumn("next_fp", following).where("__head.__tail = 0")
    return out.select(
        F.col("__head.__id").alias(doc_id), F.col("__head.n").alias("n_chars"), F.col("__head.sha").alias("edited_sha256"),
        rendered(F.col("fp")).alias("fingerprint"), rendered(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
