"""SHA-256 of files of any size, computed in tasks: the driver sees paths and digests only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files up to this many bytes are read as one value each; bigger ones as streams.
WHOLE = 64 << 20
#: Bytes of a piece in a tree digest.
PIECE = 256 << 20
_CHUNK = 8 << 20


def _open(path: str, seekable: bool = False):
    """An input of a file as Spark names it, for a task in Python."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        where, at = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        where, at = fs.FileSystem.from_uri(("s3" if scheme == "s3a" else scheme) + ":" + quote(rest))
    return where.open_input_file(at) if seekable else where.open_input_stream(at)


def _hash(f, left: int | None = None) -> str:
    h = hashlib.sha256()
    while left is None or left > 0:
        part = f.read(_CHUNK if left is None else min(_CHUNK, left))
        if not part:
            break
        h.update(part)
        left = None if left is None else left - len(part)
    return h.hexdigest()


def _streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, length in zip(b["path"], b["length"], strict=True):
            with _open(path) as f:
                yield pd.DataFrame({"path": [path], "length": [length], "sha256": [_hash(f)]})


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for r in b.itertuples():
            with _open(r.path, seekable=True) as f:
                f.seek(r.start)
                yield pd.DataFrame({"path": [r.path], "length": [r.length], "nth": [r.nth], "sha256": [_hash(f, min(r.piece, r.length - r.start))]})


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Spark lists the files (empty ones and names that begin with _ or . are left out); their content is read only where it is selected."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def file_digests(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """path, length, sha256 of the file or of all files below the folder. Files of more than `whole` bytes are streamed, each by one task, as SHA-256 goes
    from front to end; for files that should be split among tasks there is tree_digests. The streams need a file system that pyarrow can open."""
    files = _files(spark, path)
    small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    big = files.select("path", "length").where(F.col("length") > whole).repartition("path").mapInPandas(_streams, "path string, length long, sha256 string")
    return small.unionByName(big)


def tree_digests(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """path, length, pieces, sha256 of each file: SHA-256 of the hex digests of its pieces of `piece` bytes, one after the other. Pieces are hashed by any
    number of tasks."""
    last = (F.ceil(F.col("length") / piece) - 1).cast("long")
    parts = _files(spark, path).select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("nth"))
    parts = parts.withColumns({"start": F.col("nth") * piece, "piece": F.lit(piece).cast("long")}).repartition("path", "nth")
    hashed = parts.mapInPandas(_pieces, "path string, length long, nth long, sha256 string")
    order = F.array_sort(F.collect_list(F.struct("nth", "sha256")))
    return hashed.groupBy("path", "length").agg(F.count(F.lit(1)).alias("pieces"), F.sha2(F.array_join(F.transform(order, lambda p: p["sha256"]), ""), 256).alias("sha256"))


def folder_digest(digests: DataFrame) -> str:
    """The digest of a single file, or SHA-256 of all files' digests by path; the driver holds a partition of them at a time."""
    rows = digests.select("path", "sha256").persist()
    total, n, first = hashlib.sha256(), 0, ""
    for r in rows.orderBy("path").toLocalIterator():
        first, n = first or r["sha256"], n + 1
        total.update(r["sha256"].encode())
    rows.unpersist()
    return first if n == 1 else total.hexdigest()
