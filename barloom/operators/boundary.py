"""Train and out-of-sample periods and the guards between them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import DataConfig


@dataclass(frozen=True)
class SampleBoundary:
    """Inclusive ISO dates; the train period must end before the other begins."""

    train_start: str
    train_end: str
    oos_start: str
    oos_end: str

    def __post_init__(self) -> None:
        a, b, c, d = map(date.fromisoformat, (self.train_start, self.train_end, self.oos_start, self.oos_end))
        if not (a < b < c < d):
            raise ValueError("periods must be ordered: train_start < train_end < oos_start < oos_end")

    @classmethod
    def from_config(cls, c: DataConfig) -> SampleBoundary:
        return cls(c.train_start, c.train_end, c.oos_start, c.oos_end)

    def is_train(self, day: str = "trade_date") -> Column:
        return F.col(day).between(F.lit(self.train_start).cast("date"), F.lit(self.train_end).cast("date"))

    def is_oos(self, day: str = "trade_date") -> Column:
        return F.col(day).between(F.lit(self.oos_start).cast("date"), F.lit(self.oos_end).cast("date"))

    def train(self, panel: DataFrame) -> DataFrame:
        return panel.where(self.is_train())

    def oos(self, panel: DataFrame) -> DataFrame:
        return panel.where(self.is_oos())


class LeakageError(ValueError):
    pass


class LeakageGuard:
    """Remembers violations; each check raises LeakageError."""

    def __init__(self, boundary: SampleBoundary):
        self.boundary = boundary
        self.violations: list[str] = []
        self.oos_loaded = False

    def mark_oos_loaded(self) -> None:
        self.oos_loaded = True

    def _fail(self, what: str) -> None:
        self.violations.append(what)
        raise LeakageError(what)

    def check_no_oos_rows(self, train: DataFrame) -> None:
        row = train.where(self.boundary.is_oos()).select("trade_date").limit(1).collect()
        if row:
            self._fail(f"train data has a row of {row[0][0]}, inside the out-of-sample period")

    def check_distinct(self, train_fingerprint: str, oos_fingerprint: str) -> None:
        if train_fingerprint == oos_fingerprint:
            self._fail("train and out-of-sample data are the same")
