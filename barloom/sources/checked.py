"""Reading with a side table: records that cannot become rows of the panel are kept with their file, text and reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.panel import ALIASES, EXTENSIONS, PRICES, normalize
from barloom.shared import written
from barloom.sources.readers import DataRequest, apply_request, read_any

RECORD, FILE = "__record", "__file"


class RejectedError(ValueError):
    """More records are rejected than allowed."""


@dataclass
class Checked:
    """good: rows of the panel; rejected: file, record, reason; counts: records by reason."""

    good: DataFrame
    rejected: DataFrame
    rows: int
    counts: dict[str, int]

    @property
    def share(self) -> float:
        return sum(self.counts.values()) / self.rows if self.rows else 0.0


def _reason(names: dict[str, str], kinds: dict[str, str]) -> Column:
    """The first reason why a record is no row, else NULL. names: the file's name of each panel column; a value that is missing is no reason, one that
    cannot be read is."""
    raw = lambda c: F.trim(F.col(f"__raw.`{names[c]}`").cast("string"))
    given = lambda c: F.coalesce(raw(c) != "", F.lit(False))
    out = F.when(F.col(RECORD).isNotNull(), "malformed record")
    for c in ("symbol", "trade_date"):
        out = out.when(~given(c), f"no {c}") if c in names else out.when(F.lit(True), f"no {c}")
    for c in ["trade_date", *PRICES, "volume", *EXTENSIONS]:
        if c not in names or EXTENSIONS.get(c) == "string":
            continue
        numeric = c in (*PRICES, "volume") or EXTENSIONS.get(c) == "double"
        if numeric and kinds[names[c]] != "string":  # typed numbers need no reading
            continue
        unread = F.expr(f"try_cast(trim(__raw.`{names[c]}`) as double)").isNull() if numeric else F.col(c).isNull()  # NaN is read: it counts as missing
        out = out.when(given(c) & unread, f"unreadable {c}")
    return out


def load_checked(spark: SparkSession, request: DataRequest, most: float = 0.01, market: str = "CN", exchange: str = "UNKNOWN") -> Checked:
    """Bars of a CSV, JSON or Parquet file or folder, as FileSource reads them, and what had to be left out. The input is read once (JSON once more for
    its columns) and written with its reasons to the shared folder; good and rejected rows are read from there.

    A record of CSV with too few or too many fields, and a line of a JSON Lines file that is no record, is malformed; so is a whole file of an array
    that cannot be read. Records whose share is above `most` raise RejectedError. Of an empty input nothing is rejected.
    """
    raw = read_any(spark, request.path, bad=RECORD, file=FILE)
    fields = [c for c in raw.columns if c not in (RECORD, FILE)]
    canonical = [ALIASES.get(c.strip().lower(), c.strip().lower()) for c in fields]
    names, kinds = dict(zip(canonical, fields, strict=True)), dict(raw.dtypes)
    tagged = normalize(raw.withColumn("__raw", F.struct(*[F.col(f"`{c}`") for c in fields])), market, exchange)
    text = F.when(F.col("__why").isNotNull(), F.coalesce(RECORD, F.to_json("__raw")))
    tagged = tagged.withColumn("__why", _reason(names, kinds)).withColumn(RECORD, text).drop("__raw")
    kept = written(tagged, "checked")
    by_reason = {r["__why"]: r["n"] for r in kept.groupBy("__why").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, counts = sum(by_reason.values()), {k: by_reason[k] for k in sorted(k for k in by_reason if k is not None)}
    good = apply_request(kept.where("__why is null").drop("__why", RECORD, FILE), request)
    rejected = kept.where("__why is not null").select(F.col(FILE).alias("file"), F.col(RECORD).alias("record"), F.col("__why").alias("reason"))
    out = Checked(good, rejected, rows, counts)
    if out.share > most:
        raise RejectedError(f"{sum(counts.values())} of {rows} records are rejected, at most {most:.2%} may be: " + ", ".join(f"{k}: {n}" for k, n in counts.items()))
    return out
