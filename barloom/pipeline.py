"""The whole research run: data, gate, scores, deduplication, out-of-sample check, back-test, report.

Each step is one Spark job over all factors. What reaches the driver is a row for each factor or strategy.
"""

from __future__ import annotations

import functools
import json
import logging
import os
import platform
from typing import Any

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import Config
from barloom.library import Factor, Registry, seed_factors
from barloom.operators import backtest, metrics, neighbours, quality, scoring
from barloom.operators.boundary import LeakageGuard, SampleBoundary
from barloom.panel import fingerprint, manifest, profile, validate
from barloom.plans.expressions import parse
from barloom.plans.increment import with_warm_up
from barloom.plans.slices import look_back
from barloom.sources.committed import ResultSet
from barloom.sources.readers import SOURCES, DataRequest
from barloom.sources.sinks import write_checksums, write_json, write_records, write_report

log = logging.getLogger(__name__)

RUN_STRATEGIES = ("top_quantile", "long_short", "equal_weight")


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict() for r in df.orderBy(df.columns[0]).collect()]


class PipelineRunner:
    """warm_up: out-of-sample factors that look back a bounded number of rows see the train period's last rows (else they start cold).
    results: a folder of any Hadoop file system where the run's tables and report are committed as one version."""

    def __init__(self, spark: SparkSession, config: Config | None = None, registry: Registry | None = None, warm_up: bool = False, results: str = ""):
        self.spark, self.config, self.warm_up = spark, config or Config(), warm_up
        self.results = ResultSet(spark, results) if results else None
        self.registry = registry or Registry(seed_factors())

    def load(self, source: str, path: str) -> DataFrame:
        d = self.config.data
        return SOURCES[source].load(self.spark, DataRequest(path, d.train_start, d.oos_end))

    def run(self, source: str = "synthetic", path: str = "", panel: DataFrame | None = None) -> dict[str, Any]:
        c, out = self.config, self.config.output_dir
        bounds = SampleBoundary.from_config(c.data)
        log.info("run over %s to %s, factors: %d", c.data.train_start, c.data.oos_end, self.registry.count())
        write_json(c.to_dict(), f"{out}/config_snapshot.json")
        write_json({"python": platform.python_version(), "pyspark": pyspark.__version__, "platform": platform.platform()}, f"{out}/environment.json")
        panel = (self.load(source, path) if panel is None else panel).persist()
        result: dict[str, Any] = {"warnings": validate(panel), "data": {**profile(panel), "data_fingerprint": fingerprint(panel)}}
        write_json(manifest(panel, source, path), f"{out}/data_manifest.json")

        train, oos = bounds.train(panel).persist(), bounds.oos(panel).persist()
        guard = LeakageGuard(bounds)
        guard.check_no_oos_rows(train)
        marks = {"train_fingerprint": fingerprint(train), "oos_fingerprint": fingerprint(oos)}
        guard.check_distinct(*marks.values())
        write_json({**marks, "config_fingerprint": c.fingerprint(), "periods": c.to_dict()["data"]}, f"{out}/run_manifest.json")

        factors = self.registry.all_factors()
        gate = quality.check_all(factors, train, c.quality, c.scope, c.seed)
        for f, r in zip(factors, gate, strict=True):
            f.status, f.reason = ("passed", "") if r.passed else ("rejected", r.error)
        result["quality"] = [r.to_dict() for r in gate]
        log.info("gate: %d of %d factors pass", sum(r.passed for r in gate), len(gate))
        write_records(result["quality"], f"{out}/quality/factor_quality.csv")

        passed = self.registry.passed_factors()
        if not passed:
            return self._finish(result)

        def values(part: DataFrame) -> DataFrame:
            withret = metrics.with_forward_return(part, c.factors.forward_period)
            return self.registry.evaluate_all(withret, c.scope, ("forward_return",), passed)

        train_values = values(train).persist()
        scored = scoring.classify(scoring.composite_score(metrics.all_metrics(train_values, c.factors.annualization)), c.factors).persist()
        result["scores"] = _rows(scored)
        result["status_counts"] = {r["status"]: r["n"] for r in scoring.status_counts(scored).collect()}
        write_records(result["scores"], f"{out}/train/train_metrics.csv")

        order = [f.factor_id for f in passed]
        by_id = {r["factor_id"]: r for r in result["scores"]}
        for f in passed:
            f.train_metrics = {k: v for k, v in by_id.get(f.factor_id, {}).items() if isinstance(v, float)}
        kept = order
        if c.dedup.numerical_dedup:
            listed = self.spark.createDataFrame([(f.factor_id, i, len(f.expression)) for i, f in enumerate(passed)], "factor_id string, pos int, length int")
            merits = scored.select("factor_id", F.col("composite_score").alias("score"), "coverage", "turnover")
            close = neighbours.close_pairs(scoring.daily_means(train_values), c.dedup.absolute_correlation_threshold)
            flags = {r["factor_id"] for r in neighbours.keep_best(listed.join(merits, "factor_id", "left"), close).where("kept").collect()}
            kept = [f for f in order if f in flags]
        removed = [f for f in order if f not in kept]
        result["dedup"] = {"before": len(order), "after": len(kept), "removed": removed}
        write_records([{"factor_id": f, "kept": f in kept} for f in order], f"{out}/dedup/dedup_results.csv")
        write_records([{"factor_id": f.factor_id, "expression": f.expression} for f in passed if by_id[f.factor_id]["status"] == "elite"], f"{out}/elite_factors/elite_factors.csv")

        guard.mark_oos_loaded()
        oos_values = self._warm_values(train, oos, passed) if self.warm_up else values(oos)
        paired = scoring.oos_pairing(scored, metrics.all_metrics(oos_values, c.factors.annualization))
        result["oos"] = _rows(paired)
        write_records(result["oos"], f"{out}/oos/oos_metrics.csv")

        first = self.registry.evaluate_factor(order[0], train, c.scope).persist()
        result["portfolio"] = [{"strategy": s, **backtest.run(first, train, s, c.portfolio).first().asDict()} for s in RUN_STRATEGIES]
        write_records(result["portfolio"], f"{out}/portfolio/portfolio_results.csv")
        done = self._finish(result)
        if self.results:
            strategies = self.spark.createDataFrame([{k: float(v) if isinstance(v, int) else v for k, v in p.items()} for p in result["portfolio"]])
            gates = self.spark.createDataFrame([(q["factor_id"], q["passed"], json.dumps(q, default=str)) for q in result["quality"]], "factor_id string, passed boolean, told string")
            with open(done["report"], encoding="utf-8") as f:
                texts = {"report.html": f.read()}
            tables = {"scores": scored, "oos": paired, "train_values": train_values, "portfolio": strategies, "quality": gates}
            done["version"] = self.results.commit(tables, {**marks, "config": c.to_dict(), "data": result["data"], "dedup": result["dedup"]}, texts)
        for df in (first, scored, train_values, oos, train, panel):
            df.unpersist()
        return done

    def _warm_values(self, train: DataFrame, oos: DataFrame, factors: list[Factor]) -> DataFrame:
        """Long values of the out-of-sample rows. Forward returns are those of the period itself; factors of whole histories start cold."""
        rows = metrics.with_forward_return(oos.where("symbol is not null"), self.config.factors.forward_period)
        warm = {f.factor_id: f for f in factors if look_back(parse(f.expression)) is not None}
        cold = [f for f in factors if f.factor_id not in warm]
        wide = with_warm_up(train.where("symbol is not null"), rows, {f"__f{i}": f.expression for i, f in enumerate(warm.values())})
        each = [F.struct(F.lit(n).alias("factor_id"), (F.col(f"__f{i}") * float(f.direction)).alias("factor_value")) for i, (n, f) in enumerate(warm.items())]
        names = ["factor_id", "symbol", "trade_date", "forward_return", "factor_value"]
        parts = [wide.select("symbol", "trade_date", "forward_return", F.inline(F.array(*each))).select(*names)] if warm else []
        if cold:
            parts.append(self.registry.evaluate_all(rows, self.config.scope, ("forward_return",), cold).select(*names))
        return functools.reduce(DataFrame.unionByName, parts)

    def _finish(self, result: dict[str, Any]) -> dict[str, Any]:
        out = self.config.output_dir
        log.info("results in %s", out)
        result["report"] = write_report(result, os.path.join(out, "report"))
        write_checksums(out)
        return result
