"""Line deduplication across documents.

Lines are exploded as 128-bit hashes of their normalised keys with document and position; documents are
counted by hash (as smallest and largest id, which combine before the shuffle and decide "two or more");
positions to drop are gathered by document, and every text is put together again from the positions left.
Line texts themselves never move: only hashes do, and each text once, to meet its own positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import BLANKS, ascii_lower, stage

MIN_CHARS, MIN_DOCS = 10, 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs with the text replaced by what stays, and n_lines, n_dropped (long).

    A key of min_chars code points or more that min_docs documents or more hold loses all its lines except
    in the document with the smallest id. Documents are told apart by id: rows that repeat an id are one
    document, each with its own text. Null texts are one empty line. Rows with a null id keep their text and
    count for nothing. Columns n_lines and n_dropped of docs, if any, are replaced; all other columns
    are kept. Long texts cost as much a line as short ones. Of equal ids (ties) none comes first: they hold a line together. An empty table gives
    an empty one.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(body, F.lit("\n"), -1)

    def hashed(line: Column) -> Column:
        key = line_key(line)
        # the constant comes first: a column's hash is the seed of the next, so after the key it would tell nothing new
        return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))

    # keys are hashed before they are exploded: what is selected beside a generator would be copied for every line, the text itself among it
    keyed = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.xxhash64(body).alias("__body"), F.transform(lines, hashed).alias("__keys"))
    at = keyed.select("__id", "__body", F.posexplode("__keys").alias("__pos", "__h"))
    at = at.where("__h is not null").select("__id", "__body", "__pos", F.col("__h.a").alias("__a"), F.col("__h.b").alias("__b"))
    at = stage(at, "lines")
    if min_docs == 2:
        held = at.groupBy("__a", "__b").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first < __last")
    else:
        held = at.select("__a", "__b", "__id").distinct().groupBy("__a", "__b").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__last")).where(F.col("__last") >= min_docs)
    # both sides of the next join are plain tables, so that adaptive execution can split a hot hash
    held = stage(held.select("__a", "__b", "__first"), "repeated")
    drops = at.join(held, ["__a", "__b"]).where("__id <> __first").groupBy("__id", "__body").agg(F.collect_set("__pos").alias("__barloom_drop"))
    # names of their own, since docs may have columns of any name
    own = {"__id": "__barloom_id", "__body": "__barloom_of"}
    out = docs.drop("n_lines", "n_dropped").withColumn("__barloom_body", F.xxhash64(body))
    out = out.join(drops.withColumnsRenamed(own), (F.col(doc_id) == F.col("__barloom_id")) & (F.col("__barloom_body") == F.col("__barloom_of")), "left")
    n = F.size(lines)

    def joined(held: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(held) - 1), F.col("__barloom_drop"))
        return F.array_join(F.transform(left, lambda i: F.get(held, i)), "\n")

    # the lines are bound once: named inside the inner function, the text would be split again for every line
    kept = F.when(F.col("__barloom_drop").isNull(), body).otherwise(F.get(F.transform(F.array(lines), joined), F.lit(0)))
    return out.withColumns(
        {"n_lines": n.cast("long"), "n_dropped": F.when(F.col("__barloom_drop").isNull(), F.lit(0)).otherwise(F.size("__barloom_drop")).cast("long"), text: kept}
    ).drop("__barloom_id", "__barloom_of", "__barloom_body", "__barloom_drop")
