"""Panel sources: CSV, Parquet, JSON, vendor exports and synthetic bars."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from barloom.panel import KEYS, normalize

#: Symbol lists longer than this join as a table instead of an IN list.
MOST_IN_LIST = 1_000


@dataclass
class DataRequest:
    """What to read: inclusive dates, symbols and fields; empty values mean everything."""

    path: str = ""
    start_date: str = ""
    end_date: str = ""
    symbols: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)


class PanelSource(Protocol):
    def load(self, spark: SparkSession, request: DataRequest) -> DataFrame: ...


def apply_request(df: DataFrame, request: DataRequest) -> DataFrame:
    """Date range, symbols and projection; on Parquet with typed dates all three reach the scan."""
    if request.start_date:
        df = df.where(F.col("trade_date") >= F.lit(request.start_date).cast("date"))
    if request.end_date:
        df = df.where(F.col("trade_date") <= F.lit(request.end_date).cast("date"))
    if len(request.symbols) > MOST_IN_LIST:
        names = df.sparkSession.createDataFrame([(s,) for s in request.symbols], "symbol string").distinct()
        df = df.join(names, "symbol", "left_semi")
    elif request.symbols:
        df = df.where(F.col("symbol").isin(list(request.symbols)))
    if request.fields:
        keep = [c for c in df.columns if c in KEYS or c in request.fields]
        df = df.select(*keep)
    return df


def read_any(spark: SparkSession, path: str, bad: str = "", file: str = "") -> DataFrame:
    """A raw table by file ending. Text columns of CSV stay text, so that symbols keep leading zeros.

    bad: a column to add with the text of records that cannot be read, which otherwise are filled up or cut (CSV) or an error (JSON Lines);
    file: a column to add with the file's path.
    """
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending == ".csv":
        reader = spark.read.option("header", True)
        if bad:
            fields = [StructField(c, StringType()) for c in reader.csv(path).columns]
            # without column pruning, a record's fields are counted whatever is selected
            reader = reader.schema(StructType([*fields, StructField(bad, StringType())])).option("columnNameOfCorruptRecord", bad).option("columnPruning", False)
        return with_file(reader.csv(path), file)
    if ending == ".parquet":
        df = with_file(spark.read.parquet(path), file)
        return df.withColumn(bad, F.lit(None).cast("string")) if bad else df
    if ending in (".json", ".jsonl", ".ndjson"):
        return read_json(spark, path, bad, file)
    raise ValueError(f"cannot tell the format of {path}")


def with_file(df: DataFrame, name: str) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias(name)) if name else df


def read_json(spark: SparkSession, path: str, bad: str = "", file: str = "") -> DataFrame:
    """Records as JSON Lines, or as files that each hold an array of records or one record over several lines; a folder may hold both kinds. A file
    is taken as lines, which Spark splits among tasks, if its first line that isn't blank, or more than half of its lines, open with { and close all braces that they open. Of each file the driver learns
    its path and kind. A line that is no record, in a file of lines, is an error rather than a row of nulls; with bad, it is a row with its text in that column."""
    line = F.trim("value", F.lit(" \t\r\ufeff"))
    count = lambda c: F.char_length("value") - F.char_length(F.translate("value", c, ""))
    whole = F.col("value").startswith("{") & F.col("value").endswith("}") & (count("{") == count("}"))
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), line.alias("value")).where("value <> ''")
    kinds = text.select("file", "at", whole.alias("lines")).groupBy("file").agg((F.min_by("lines", "at") | (2 * F.count_if("lines") > F.count(F.lit(1)))).alias("lines")).collect()
    if not kinds:  # no line: no record
        return spark.createDataFrame([], "symbol string, trade_date string" + "".join(f", {c} string" for c in (bad, file) if c))

    def read(lines: bool, files: str | list[str]) -> DataFrame:
        reader = spark.read.option("primitivesAsString", True)
        if lines and not bad:
            reader = reader.option("mode", "FAILFAST")
        if not lines:
            reader = reader.option("multiLine", True)
        if not bad:
            return with_file(reader.json(files), file)
        reader = reader.option("columnNameOfCorruptRecord", bad)
        fields = [f for f in reader.json(files).schema if f.name != bad]
        return with_file(reader.schema(StructType([*fields, StructField(bad, StringType())])).json(files), file)

    parts = [(lines, [r["file"] for r in kinds if r["lines"] == lines]) for lines in (True, False)]
    parts = [(lines, files) for lines, files in parts if files]
    if len(parts) == 1:
        return read(parts[0][0], path)
    one, two = (read(lines, [unquote(f) for f in files]) for lines, files in parts)
    return one.unionByName(two, allowMissingColumns=True)


@dataclass
class FileSource:
    """Bars from a file or folder; formats: endings that this source takes."""

    formats: tuple[str, ...] = (".csv", ".parquet", ".json", ".jsonl", ".ndjson")
    market: str = "CN"
    exchange: str = "UNKNOWN"

    def load(self, spark: SparkSession, request: DataRequest) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(request.path)
        if not request.path or not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            raise FileNotFoundError(request.path)
        if os.path.splitext(request.path.rstrip("/"))[1].lower() not in self.formats:
            raise ValueError(f"{request.path}: expected {', '.join(self.formats)}")
        return apply_request(normalize(read_any(spark, request.path), self.market, self.exchange), request)


def csv_source() -> FileSource:
    return FileSource((".csv",))


def parquet_source() -> FileSource:
    return FileSource((".parquet",))


def vendor_a_source() -> FileSource:
    """Exports with ts_code, trade_date as digits, vol and amount."""
    return FileSource(market="CN")


def vendor_b_source() -> FileSource:
    """Exports with ticker and date."""
    return FileSource(market="GLOBAL")


def vendor_c_source() -> FileSource:
    """Exports as records with canonical names."""
    return FileSource()


@dataclass
class SyntheticSource:
    """Deterministic OHLC-consistent random walks. Every draw is a hash of seed, symbol, date and purpose, so the
    panel is the same however it is partitioned, and symbols are generated in parallel."""

    n_symbols: int = 50
    seed: int = 42

    def load(self, spark: SparkSession, request: DataRequest) -> DataFrame:
        start, end = request.start_date or "2020-01-01", request.end_date or "2023-12-31"
        i = F.col("i")

        def uniform(*what):
            return (F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), *what), 11).cast("double") + 0.5) / float(1 << 53)

        def normal(tag: int):
            u, v = (uniform(i, F.col("trade_date"), F.lit(tag * 2 + k)) for k in (0, 1))
            return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)

        symbols = spark.range(self.n_symbols).select(
            F.col("id").alias("i"), F.concat(F.lit("S"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("symbol")
        )
        days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("trade_date")
        days = symbols.select("i", "symbol", days).where(F.weekday("trade_date") < 5)
        base, drift, vol = 10 + 90 * uniform(i, F.lit("base")), -0.0005 + 0.0015 * uniform(i, F.lit("drift")), 0.01 + 0.02 * uniform(i, F.lit("vol"))
        step = F.log(F.greatest(1 + drift + vol * normal(0), F.lit(0.05)))
        walk = Window.partitionBy("symbol").orderBy("trade_date")
        df = days.withColumn("step", step).withColumn("sum", F.sum("step").over(walk.rowsBetween(Window.unboundedPreceding, 0)))
        close, before = base * F.exp("sum"), base * F.exp(F.col("sum") - F.col("step"))
        df = df.withColumns({"close": F.round(close, 4), "open": F.round(before * (1 + 0.003 * normal(1)), 4)})
        df = df.withColumns(
            {
                "high": F.round(F.greatest("open", "close") * (1 + F.abs(0.005 * normal(2))), 4),
                "low": F.round(F.least("open", "close") * (1 - F.abs(0.005 * normal(3))), 4),
                "volume": F.floor(1e6 + 4.9e7 * uniform(i, F.col("trade_date"), F.lit("volume"))).cast("double"),
            }
        )
        out = df.select(
            "symbol", "trade_date", "open", "high", "low", "close", "volume", F.round(F.col("volume") * F.col("close"), 2).alias("amount"),
            F.lit("CN").alias("market"), F.lit("SYNTH").alias("exchange"), F.lit("synthetic").alias("source"),
            F.lit("2020-01-01T00:00:00").alias("fetched_at"), F.lit("synthetic-v1").alias("data_version"),
        )
        return apply_request(out, request)


SOURCES: dict[str, PanelSource] = {
    "csv": csv_source(), "parquet": parquet_source(), "vendor_a": vendor_a_source(), "vendor_b": vendor_b_source(), "vendor_c": vendor_c_source(),
    "synthetic": SyntheticSource(),
}


def preview(df: DataFrame, n_rows: int = 50) -> DataFrame:
    return df.limit(n_rows)
