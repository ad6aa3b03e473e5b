"""Writers of results: tables by Spark, manifests and reports as small files from the driver."""

from __future__ import annotations

import csv
import hashlib
import html
import json
import os
from typing import Any

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A result of any size, written by the executors."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_records(rows: list[dict[str, Any]], path: str) -> None:
    """A report table (a row for each factor or strategy) as one CSV file."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    names = list(dict.fromkeys(k for r in rows for k in r))
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, names)
        w.writeheader()
        w.writerows(rows)


def write_json(value: Any, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, default=str)


def write_checksums(folder: str, name: str = "SHA256SUMS") -> str:
    """SHA-256 of every file below folder, in order of their paths."""
    lines = []
    for d, dirs, files in os.walk(folder):
        dirs.sort()
        for x in sorted(files):
            if x != name:
                with open(os.path.join(d, x), "rb") as f:
                    lines.append((os.path.relpath(os.path.join(d, x), folder), hashlib.file_digest(f, "sha256").hexdigest()))
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{h}  {p}\n" for p, h in sorted(lines))
    return path


def _table(rows: list[dict[str, Any]], columns: list[str]) -> str:
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else html.escape(str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{show(r.get(c, ''))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def write_report(result: dict[str, Any], folder: str) -> str:
    """report.html and summary.json of a pipeline run."""
    counts = result.get("status_counts", {})
    parts = [
        "<!DOCTYPE html><meta charset='utf-8'><title>Factor report</title><style>body{font-family:sans-serif;margin:2em}td,th{border:1px solid #ccc;padding:2px 8px}table{border-collapse:collapse}</style>",
        "<h1>Factor report</h1><p>Research only; no investment advice.</p>", "<h2>Data</h2>", _table([result.get("data", {})], ["rows", "n_symbols", "start_date", "end_date", "data_fingerprint"]),
        "<h2>Quality</h2>", _table(result.get("quality", []), ["factor_id", "passed", "stage", "error", "valid_ratio", "complexity"]),
        "<h2>Scores</h2><p>" + ", ".join(f"{k}: {v}" for k, v in sorted(counts.items())) + "</p>",
        _table(result.get("scores", []), ["factor_id", "status", "composite_score", "ic_mean", "icir", "rankic_mean", "rankicir", "coverage", "turnover"]),
        "<h2>Out of sample</h2>", _table(result.get("oos", []), ["factor_id", "train_ic", "oos_ic", "decay_ratio", "sign_consistent"]),
        "<h2>Portfolios</h2>", _table(result.get("portfolio", []), ["strategy", "annual_return", "annual_volatility", "sharpe_ratio", "max_drawdown", "turnover", "total_cost"]),
    ]
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "report.html")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(parts))
    write_json({k: v for k, v in result.items() if k != "quality"} | {"passed_quality": sum(q["passed"] for q in result.get("quality", []))}, os.path.join(folder, "summary.json"))
    return path
