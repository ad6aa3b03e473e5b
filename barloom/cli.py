"""Command line: doctor, init, generate-demo-data, run-all, demo."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from barloom.config import Config
from barloom.log import set_up


def session() -> SparkSession:
    return SparkSession.builder.appName("barloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("barloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor", help="check the environment")
    sub.add_parser("init", help="write a configuration with all defaults").add_argument("path", nargs="?", default="config.json")
    g = sub.add_parser("generate-demo-data", help="write synthetic bars")
    g.add_argument("path")
    g.add_argument("--symbols", type=int, default=50)
    for name in ("run-all", "demo"):
        r = sub.add_parser(name, help="run the whole pipeline")
        r.add_argument("--config")
        r.add_argument("--source", default="synthetic")
        r.add_argument("--path", default="")
        r.add_argument("--output", default="results")
    a = p.parse_args(argv)
    if a.command == "init":
        with open(a.path, "w") as f:
            json.dump(Config().to_dict(), f, indent=2)
        return 0
    spark = session()
    if a.command == "doctor":
        print(f"Spark {spark.version}, {spark.sparkContext.master}, {spark.range(1000).count()} rows counted")
        return 0
    if a.command == "generate-demo-data":
        from barloom.sources.readers import DataRequest, SyntheticSource
        from barloom.sources.sinks import write_table

        write_table(SyntheticSource(a.symbols).load(spark, DataRequest()), a.path, "csv" if a.path.endswith(".csv") else "parquet")
        return 0
    from barloom.pipeline import PipelineRunner

    c = Config.from_file(a.config) if a.config else Config()
    if a.command == "demo":
        c = Config.from_dict({**c.to_dict(), "data": {**c.data.to_dict(), "train_start": "2022-01-03", "train_end": "2022-06-30", "oos_start": "2022-07-01", "oos_end": "2022-12-30"}})
    c.output_dir = a.output
    set_up(c.log_level, f"{a.output}/run.log")
    out = PipelineRunner(spark, c).run(a.source, a.path)
    print(json.dumps({"status_counts": out.get("status_counts"), "dedup": out.get("dedup"), "report": out["report"]}, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
