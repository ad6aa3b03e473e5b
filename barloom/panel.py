"""The panel: one row per symbol and trade date. Schema, normalisation, validation, manifest."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.digests import file_digests, folder_digest

# Required columns, optional ones with their types, and header aliases.
REQUIRED = ["symbol", "trade_date", "open", "high", "low", "close", "volume"]
EXTENSIONS = {
    "market": "string", "exchange": "string", "currency": "string", "amount": "double", "turnover": "double", "adj_factor": "double",
    "list_date": "date", "delist_date": "date", "is_st": "boolean", "is_limit_up": "boolean", "is_limit_down": "boolean",
    "is_suspended": "boolean", "source": "string", "source_symbol": "string", "fetched_at": "timestamp_ntz", "data_version": "string",
}
ALIASES = {
    "ts_code": "symbol", "code": "symbol", "ticker": "symbol", "date": "trade_date", "datetime": "trade_date",
    "vol": "volume", "amt": "amount", "pct_chg": "pct_change",
}
KEYS = ["market", "exchange", "symbol", "trade_date"]
PRICES = ["open", "high", "low", "close"]


def by_date() -> Any:
    """Each symbol's rows in date order."""
    return Window.partitionBy("symbol").orderBy("trade_date")


def as_date(df: DataFrame, name: str) -> Column:
    """A date from a date, a timestamp, or text or digits such as 2022-01-03 and 20220103; others become null."""
    kind, c = dict(df.dtypes)[name], F.col(name)
    if kind == "date" or kind.startswith("timestamp"):
        return c.cast("date")
    text = F.trim(c.cast("string"))
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyyMMdd"), F.try_to_timestamp(text).cast("date"))


def no_nan(c: Column) -> Column:
    """The engine knows NULL only: NaN and infinities from outside stay visible to the quality gate as infinities, NaN goes."""
    return F.when(~F.isnan(c), c)


def normalize(df: DataFrame, market: str = "CN", exchange: str = "UNKNOWN") -> DataFrame:
    """Headers trimmed and lower-cased, aliases renamed, types set, market and exchange filled in if absent.

    Two columns that end up with one name are an error.
    """
    names = [c.strip().lower() for c in df.columns]
    names = [ALIASES.get(n, n) for n in names]
    if len(set(names)) < len(names):
        raise ValueError(f"columns share a name after renaming: {sorted(n for n in set(names) if names.count(n) > 1)}")
    df = df.toDF(*names)
    kinds, cols = dict(df.dtypes), {}
    for n in names:
        if n == "symbol":
            cols[n] = F.col(n).cast("string")
        elif n == "trade_date" or EXTENSIONS.get(n) == "date":
            cols[n] = as_date(df, n)
        elif n in (*PRICES, "volume", "pct_change") or EXTENSIONS.get(n) == "double":
            c = F.expr(f"try_cast(`{n}` AS DOUBLE)") if kinds[n] == "string" else F.col(n).cast("double")
            cols[n] = no_nan(c)
        elif n in EXTENSIONS and kinds[n] != EXTENSIONS[n]:
            cols[n] = F.expr(f"try_cast(`{n}` AS {EXTENSIONS[n]})")
    if "market" not in names:
        cols["market"] = F.lit(market)
    if "exchange" not in names:
        cols["exchange"] = F.lit(exchange)
    return df.withColumns(cols)


def key_columns(df: DataFrame) -> list[str]:
    return [k for k in KEYS if k in df.columns]


def duplicate_keys(df: DataFrame) -> Column:
    """Rows beyond the first of each key; null key parts count as values."""
    return F.count(F.lit(1)) - F.count_distinct(F.struct(*key_columns(df)))


def bad_bar() -> Column:
    """Whether a bar's high and low contradict its prices; bars with a missing price are not judged."""
    top, bottom = F.greatest("open", "low", "close"), F.least("open", "high", "close")
    whole = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    return F.coalesce(whole & ((F.col("high") < top) | (F.col("low") > bottom)), F.lit(False))


def validate(df: DataFrame) -> list[str]:
    """Messages about a panel; an empty list means it is sound. One aggregation, and one row of the first bad bar."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        return [f"missing columns: {', '.join(missing)}"]
    stats = validation_row(df).first()
    found = [f"{c} has values that are not positive" for c in PRICES if stats[f"low_{c}"]]
    found += ["volume has negative values"] if stats["low_volume"] else []
    found += [f"{stats['dups']} rows repeat a key"] if stats["dups"] else []
    found += [f"prices contradict high or low at {stats['bar']['symbol']} {stats['bar']['trade_date']}"] if stats["bars"] else []
    return found


def validation_row(df: DataFrame) -> DataFrame:
    """One row: counts of what validate() objects to, and the first bad bar."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c) <= 0).alias(f"low_{c}") for c in PRICES],
        F.count_if(F.col("volume") < 0).alias("low_volume"),
        duplicate_keys(df).alias("dups"),
        F.min_by(F.struct("symbol", "trade_date"), F.when(bad_bar(), F.struct("symbol", "trade_date"))).alias("bar"),
        F.count_if(bad_bar()).alias("bars"),
    )


def profile(df: DataFrame) -> dict[str, Any]:
    """Row and symbol counts, date range, missing rates and repeated keys, in one aggregation."""
    r = profile_row(df).first()
    rates = {c: r[f"missing_{c}"] for c in df.columns if r[f"missing_{c}"]}
    return {
        "rows": r["rows"], "n_symbols": r["n_symbols"], "start_date": str(r["start_date"]) if r["start_date"] else None,
        "end_date": str(r["end_date"]) if r["end_date"] else None, "fields": list(df.columns), "missing_rates": rates,
        "duplicate_keys": r["duplicate_keys"],
    }


def profile_row(df: DataFrame) -> DataFrame:
    """One row: what profile() tells."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("symbol").alias("n_symbols"),
        F.min("trade_date").alias("start_date"),
        F.max("trade_date").alias("end_date"),
        duplicate_keys(df).alias("duplicate_keys"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"missing_{c}") for c in df.columns],
    )


def fingerprint(df: DataFrame, content: bool = False) -> str:
    """SHA-256 of the panel's profile; with content, also of an order-free hash of all its rows."""
    p = profile(df)
    told = {k: p[k] for k in ("rows", "fields", "start_date", "end_date", "n_symbols", "missing_rates")}
    if content:
        told["content"] = str(df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0])
    return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()


def manifest(df: DataFrame, source: str, path: str = "", rejected: dict[str, int] | None = None) -> dict[str, Any]:
    """A snapshot's description: where it came from, the file's SHA-256 (computed in tasks; of a folder, that of
    all its files' SHA-256 by path), its profile, and counts of rejected records by reason if there are any to tell."""
    digest = folder_digest(file_digests(df.sparkSession, path)) if path else ""
    told = {"source": source, "file_path": path, "file_sha256": digest, **profile(df), "data_fingerprint": fingerprint(df)}
    return told if rejected is None else {**told, "rejected_records": rejected}
