"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of documents; the last adds the tokens of what is left.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, jaccard, line_dedup, mixing, quality_rules
from barloom.llm.common import read, stage, stage_path
from barloom.llm.queries.texts import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes that go to a Python worker at once, or one row: bounds the memory of workers and of what feeds them, not the work.
BATCH_BYTES = 8_000_000


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to BATCH_BYTES, where it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with __of, a hash of the text: with the id it tells rows apart that share an id, or have none."""
    return docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("__of"))


def _same(*names: str) -> Column:
    """Whether a row's doc_id (null equals null), __of and columns `names` equal those of the other side, marked by k_."""
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in ("doc_id", "__of", *names)])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rows that the base or a certified cutoff rejects go, null and empty texts among them. Every row is judged
    by its own text and language, whether its id is null or repeated; rows that are alike stay or go together. Long texts are judged whole; columns
    beyond COLUMNS are dropped; an empty table stays empty."""
    _small_batches(spark)
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    verdicts = quality_rules.judge(_keyed(docs), labels, stage=stage, keep=["__of"]).where("kept")
    verdicts = verdicts.select(*[F.col(c).alias(f"k_{c}") for c in ("doc_id", "__of", "lang")]).distinct()
    return _keyed(docs).join(verdicts, _same("lang"), "left_semi").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that other documents hold too stay in the first of them only. A document all of whose
    lines stay elsewhere is left as an empty text: this stage drops lines, not documents. Null texts become empty; rows
    without an id keep their text, and rows that repeat an id are one document. Long texts are split whole; columns beyond COLUMNS are dropped; an empty
    table stays empty."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five words at 0.8: the smallest doc_id of each group stays. Rows that repeat an id are one
    document and stay or go together; rows without an id or without words link with nothing and stay. Long texts are compared by their whole sets, ties at
    0.8 link; columns beyond COLUMNS are dropped; an empty table stays empty."""
    _small_batches(spark)
    others = jaccard.join_groups(docs, k=5, percent=80).where("doc_id <> component_id").select("doc_id")
    return docs.join(others.distinct(), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document is repeated as often as the mix takes it, which may be never. Rows with the same id (null
    included) and text are taken as often as the one of them that is taken most. Null and empty texts have no words to take; long texts count whole; columns
    beyond COLUMNS are dropped; an empty table stays empty."""
    taken = mixing.mix(_keyed(docs).withColumn("__key", F.struct("doc_id", "__of")), doc_id="__key")
    copies = taken.groupBy("__key").agg(F.max("copies").alias("__copies")).where("__copies > 0")
    copies = copies.select(F.col("__key.doc_id").alias("k_doc_id"), F.col("__key.__of").alias("k___of"), "__copies")
    out = _keyed(docs).join(copies, _same()).withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return out.select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: the token ids of each text and the hash of what they decode to. Null and empty texts have no tokens; every row,
    repeated or without an id, gets its own. Long texts are encoded whole; columns beyond COLUMNS are dropped; an empty table stays empty."""
    _small_batches(spark)
    coded = bpe.encode(docs, TOKENIZER, keep=COLUMNS)
    back = bpe.decode(coded, TOKENIZER, [*[c for c in COLUMNS if c != "text"], "n_tokens", "ids"])
    return back.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources", mix_sources),
    ("BPE encoding", tokenize),
]

#: No SQL: learned cutoffs, Newton iterations and merges. Tests hold the whole run against brute force, stage by stage, and run all stages on odd tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each through a Parquet table in the shared folder."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (_, step) in enumerate(STAGES):
        path = stage_path(spark, f"stage{i}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
