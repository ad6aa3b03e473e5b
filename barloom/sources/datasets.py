"""Datasets brought in from outside: uploads, registration in place, checks and previews."""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.panel import REQUIRED, bad_bar, normalize, profile
from barloom.sources.readers import preview, read_any

# Endings and size that an upload may have.
ENDINGS = (".csv", ".parquet")
MOST_BYTES = 500 * 1024 * 1024


@dataclass
class Dataset:
    name: str
    path: str
    sha256: str = ""
    size: int = 0
    info: dict[str, Any] = field(default_factory=dict)


def safe_name(name: str) -> str:
    """The last part of a file name with everything but word characters, dots and hyphens replaced."""
    return re.sub(r"[^\w.\-]", "_", os.path.basename(name.replace("\\", "/"))).lstrip(".") or "unnamed"


def upload(spark: SparkSession, name: str, content: bytes, folder: str) -> Dataset:
    """Stores an upload under a safe name and describes it."""
    name = safe_name(name)
    if os.path.splitext(name)[1].lower() not in ENDINGS:
        raise ValueError(f"{name}: expected {', '.join(ENDINGS)}")
    if len(content) > MOST_BYTES:
        raise ValueError(f"{name}: more than {MOST_BYTES} bytes")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(content)
    return Dataset(name, path, hashlib.sha256(content).hexdigest(), len(content), metadata(load(spark, path)))


def register_local(spark: SparkSession, path: str) -> Dataset:
    """Describes a file or folder where it lies."""
    return Dataset(os.path.basename(path.rstrip("/")), path, info=metadata(load(spark, path)))


def load(spark: SparkSession, path: str) -> DataFrame:
    return normalize(read_any(spark, path))


def metadata(df: DataFrame) -> dict[str, Any]:
    p = profile(df) if {"symbol", "trade_date"} <= set(df.columns) else {"rows": df.count(), "fields": list(df.columns)}
    return {k: p.get(k) for k in ("rows", "n_symbols", "start_date", "end_date", "fields")}


def check(df: DataFrame) -> dict[str, Any]:
    """Missing required fields, repeated keys and odd bars of a dataset."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        return {"valid": False, "missing_fields": missing}
    row = check_row(df).first()
    return {"valid": not (row["d"] or row["a"]), "missing_fields": [], "duplicate_keys": row["d"], "anomalies": row["a"], "bad_bars": row["b"]}


def check_row(df: DataFrame) -> DataFrame:
    """One row: repeated keys (d), odd bars by the short rule (a) and by the full one (b)."""
    return df.agg(
        (F.count(F.lit(1)) - F.count_distinct(F.struct("symbol", "trade_date"))).alias("d"),
        F.count_if((F.col("high") < F.col("low")) | (F.col("high") < F.col("open"))).alias("a"), F.count_if(bad_bar()).alias("b"),
    )


def first_rows(spark: SparkSession, path: str, n_rows: int = 50) -> DataFrame:
    return preview(read_any(spark, path), n_rows)
