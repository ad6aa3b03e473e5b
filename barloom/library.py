"""Factor definitions: the built-in expressions and a registry."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from barloom.plans.compiler import evaluate, evaluate_all
from barloom.plans.expressions import ExpressionError, expression_hash, parse

log = logging.getLogger(__name__)

# Name, level, expression, direction.
SEEDS: list[tuple[str, int, str, int]] = [
    ("trend_phase_ma", 1, "div(sub(ts_mean(close, 10), ts_mean(close, 60)), ts_mean(close, 60))", 1),
    ("volatility_regime", 1, "div(sub(ts_std(ret(close, 1), 20), ts_mean(ts_std(ret(close, 1), 20), 60)), add(ts_std(ts_std(ret(close, 1), 20), 60), 1e-8))", 1),
    ("market_state_transition", 1, "div(ts_std(ret(close, 1), 5), add(ts_std(ret(close, 1), 60), 1e-8))", -1),
    ("downside_risk", 2, "ts_mean(where(ret(close, 1) < 0, ret(close, 1), 0), 20)", -1),
    ("tail_risk", 2, "ts_min(ret(close, 1), 60)", -1),
    ("liquidity_fragility", 2, "div(sub(ts_mean(volume, 20), volume), add(ts_mean(volume, 20), 1e-8))", 1),
    ("volume_price_correlation", 3, "corr(ret(close, 1), ret(volume, 1), 20)", 1),
    ("price_impact", 3, "div(abs(ret(close, 1)), add(log1p(volume), 1e-8))", -1),
    ("volume_anomaly", 3, "div(sub(volume, ts_mean(volume, 20)), add(ts_std(volume, 20), 1e-8))", 1),
    ("midterm_momentum", 4, "div(sub(close, delay(close, 20)), delay(close, 20))", 1),
    ("short_term_reversal", 4, "mul(ret(close, 5), -1)", -1),
    ("volatility_clustering", 4, "corr(abs(ret(close, 1)), delay(abs(ret(close, 1)), 1), 20)", -1),
    ("multiscale_trend", 5, "sub(div(sub(close, delay(close, 5)), delay(close, 5)), div(sub(close, delay(close, 60)), delay(close, 60)))", 1),
    ("long_memory_approx", 5, "corr(ret(close, 1), delay(ret(close, 1), 10), 60)", -1),
    ("drawdown_recovery", 5, "div(sub(close, ts_max(close, 60)), sub(ts_max(close, 60), 1e-8))", 1),
    ("time_stability", 6, "corr(close, delay(close, 5), 20)", 1),
    ("regime_conditional_filter", 6, "where(ts_std(ret(close, 1), 20) > ts_mean(ts_std(ret(close, 1), 20), 60), mul(ret(close, 10), -1), ret(close, 10))", 1),
    ("signal_decay_control", 6, "sub(ret(close, 10), delay(ret(close, 10), 5))", 1),
    ("candle_geometry", 7, "div(sub(close, open), sub(high, low))", 1),
    ("conditional_fusion", 7, "where(ret(close, 5) > 0, mul(ret(close, 20), 1), mul(ret(close, 20), -1))", 1),
    ("nonlinear_fusion", 7, "mul(rank(ret(close, 20)), rank(mul(ts_std(ret(close, 1), 20), -1)))", 1),
]


@dataclass
class Factor:
    factor_id: str
    name: str
    expression: str
    direction: int = 1
    level: int = 0
    agent_id: str = ""
    description: str = ""
    source: str = "seed"
    status: str = "pending"
    reason: str = ""
    train_metrics: dict[str, float] = field(default_factory=dict)
    oos_metrics: dict[str, float] = field(default_factory=dict)

    @property
    def expression_hash(self) -> str:
        return expression_hash(self.expression)


def seed_factors() -> list[Factor]:
    return [
        Factor(f"seed_{i:03d}", name, e, d, level, f"Agent_{i:02d}", f"built-in factor {name.replace('_', ' ')}")
        for i, (name, level, e, d) in enumerate(SEEDS, 1)
    ]


class Registry:
    """Factors in order of registration; equal expressions are refused."""

    def __init__(self, factors: list[Factor] | None = None):
        self._by_id: dict[str, Factor] = {}
        self._by_hash: dict[str, str] = {}
        for f in factors or []:
            self.register(f)

    def register(self, factor: Factor) -> bool:
        if factor.factor_id in self._by_id or factor.expression_hash in self._by_hash:
            return False
        self._by_id[factor.factor_id] = factor
        self._by_hash[factor.expression_hash] = factor.factor_id
        return True

    def get(self, factor_id: str) -> Factor | None:
        return self._by_id.get(factor_id)

    def all_factors(self) -> list[Factor]:
        return list(self._by_id.values())

    def passed_factors(self) -> list[Factor]:
        return [f for f in self._by_id.values() if f.status == "passed"]

    def filter_by_level(self, level: int) -> list[Factor]:
        return [f for f in self._by_id.values() if f.level == level]

    def count(self) -> int:
        return len(self._by_id)

    def clear(self) -> None:
        self._by_id.clear()
        self._by_hash.clear()

    def evaluate_factor(self, factor_id: str, panel: DataFrame, scope: str = "symbol") -> DataFrame:
        f = self._by_id[factor_id]
        return evaluate(panel, f.expression, scope, f.direction)

    def evaluate_all(self, panel: DataFrame, scope: str = "symbol", keep: tuple[str, ...] = (), factors: list[Factor] | None = None) -> DataFrame:
        """All (or some) factors in one plan; those that cannot be read are left out."""
        good = {}
        for f in self.all_factors() if factors is None else factors:
            try:
                parse(f.expression)
            except ExpressionError as e:
                log.warning("factor %s cannot be read and is left out: %s", f.factor_id, e)
                continue
            good[f.factor_id] = (f.expression, f.direction)
        return evaluate_all(panel, good, scope, keep)

    def structural_dedup(self) -> list[str]:
        """Ids whose expression an earlier factor has."""
        seen: set[str] = set()
        out = []
        for f in self._by_id.values():
            if f.expression_hash in seen:
                out.append(f.factor_id)
            seen.add(f.expression_hash)
        return out
