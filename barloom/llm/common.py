"""Helpers shared by the corpus operators."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are no ASCII white space. Java and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that ends words and is stripped from line keys.
BLANKS = " \t\n\x0b\x0c\r"
SLICE_BYTES = 4_000_000
#: Stretches of an order at most (their bounds, 16 bytes each, pass the driver); beyond, stretches grow.
MOST_STRETCHES = 65_536
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and all runs on one machine (tests) a temporary folder is made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(at)
    return at


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/barloom-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Writes df as Parquet (zstd of that level) in the shared folder and reads it back.

    This cuts the lineage without depending on any executor staying alive, and lets later
    joins see the true size of the table.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stretch(keys: DataFrame, size: int) -> Column:
    """The number of a row's stretch in the order of keys, two long columns (nulls first), for tables that have these columns.

    Stretches have about size rows whatever the values are: their bounds are rows at even steps of the sorted keys. Rows with equal
    keys share a stretch.
    """
    a, b = keys.columns
    step = max(size, -(-keys.count() // MOST_STRETCHES))
    order = [F.col(a).asc_nulls_first(), F.col(b).asc_nulls_first()]
    # in a sorted partition the lower 33 bits of this id count its rows
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = keys.repartitionByRange(*order).sortWithinPartitions(*order).select(a, b, nth.alias("__nth")).where(F.col("__nth") % step == 0).collect()
    found = sorted({(r[0], r[1]) for r in rows}, key=lambda k: [(x is not None, x or 0) for x in k])
    bounds = F.from_json(F.lit(json.dumps([{"a": x, "b": y} for x, y in found])), "array<struct<a:long,b:long>>")
    key = F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    # binary search for the last bound that is not above the key
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(found).bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, n: F.when(F.get(bounds, at + n) <= key, at + n).otherwise(at)).cast("long")


def map_texts(df: DataFrame, keep: list[str], text: str, made: str, run: Callable[[list[str | None]], dict[str, Any]]) -> DataFrame:
    """The columns keep as they are, and the columns `made` (a DDL schema) that run computes from each Arrow
    batch of whole texts. Columns that are kept never leave Arrow, so null and large ids stay exact."""
    kept = [F.col(c).alias(f"__{i}") for i, c in enumerate(keep)]
    src = df.select(*kept, F.col(text).alias("__text"))
    kinds = [src.schema[f"__{i}"].dataType.simpleString() for i in range(len(keep))]
    names = [x.split()[0] for x in made.split(", ")]

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in them:
            # at most SLICE_BYTES of text at once, or one row: this bounds a worker's memory, not the work
            ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(len(keep))), 0).to_numpy())
            at = 0
            while at < len(ends):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
                b = whole.slice(at, upto - at)
                at = upto
                got = run(b.column(len(keep)).to_pylist())
                columns = [b.column(i) for i in range(len(keep))]
                columns += [x if isinstance(x, pa.Array) else pa.array(x) for x in (got[n] for n in names)]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f"__{i}" for i in range(len(keep))), *names])

    schema = ", ".join([*(f"__{i} {k}" for i, k in enumerate(kinds)), made])
    out = src.mapInArrow(batches, schema)
    return out.withColumnsRenamed({f"__{i}": c for i, c in enumerate(keep)})
