"""Long rolling windows at a cost that doesn't grow with the window.

A bounded frame is walked again for every row. Here a symbol's rows are cut into chunks as long as the window, so that each window is the end of
one chunk and the beginning of the next: running states from the front and from the back of each chunk, one step a row, give both parts, and
two states make one. States are merged, never subtracted, so no digits are lost on large values or after them:
variances and covariances are kept as counts, means and central moments of the differences from the chunk's first value (so that equal
values have no spread at all, and large ones keep that of their last digits). Everything stays in the symbol's one exchange; sorts within it meet nearly sorted rows.

A value's rank in a long window needs an order statistic, which no running state has: ranks come from a sorted list of the window's values that
each row enters and leaves by binary search, in Arrow batches of sorted partitions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import DATE, SYMBOL

#: Windows longer than this are long: bounded frames are faster below it.
LONG = 64
State = dict[str, Column]


def _moments(values: list[Column], firsts: list[Column], w: Window) -> State:
    """Count, first values, means above them and central moments of pairs (or of single values) up to here."""
    n = F.count(values[0]).over(w)
    out = {"n": n}
    small = [v - first for v, first in zip(values, firsts, strict=True)]
    for name, v, first in zip("xy", small, firsts, strict=False):
        out |= {f"f{name}": first, f"m{name}": F.avg(v).over(w), f"q{name}": F.var_pop(v).over(w) * n}
    if len(values) > 1:
        out["c"] = F.covar_pop(*small).over(w) * n
    return out


def _merged(a: State, b: State) -> State:
    """The moments of both parts together; a part without values has none."""
    n = a["n"] + b["n"]
    share = a["n"] * b["n"] / F.nullif(n, F.lit(0))
    zero = F.lit(0.0)
    out = {"n": n}
    apart = {x: (b[f"f{x}"] - a[f"f{x}"]) + (b[f"m{x}"] - a[f"m{x}"]) for x in "xy" if f"m{x}" in a}
    for name, d in apart.items():
        out[f"q{name}"] = F.coalesce(a[f"q{name}"], zero) + F.coalesce(b[f"q{name}"], zero) + F.coalesce(d * d * share, zero)
    if "c" in a:
        out["c"] = F.coalesce(a["c"], zero) + F.coalesce(b["c"], zero) + F.coalesce(apart["x"] * apart["y"] * share, zero)
    return out


def _sum_state(values: list[Column], firsts: list[Column], w: Window) -> State:
    return {"n": F.count(values[0]).over(w), "s": F.sum(values[0]).over(w)}


def _total(a: State, b: State) -> tuple[Column, Column]:
    n = a["n"] + b["n"]
    return F.when(n > 0, F.coalesce(a["s"], F.lit(0.0)) + F.coalesce(b["s"], F.lit(0.0))), n


def _mean(a: State, b: State) -> Column:
    total, n = _total(a, b)
    return total / n


def _sample(m: State, of: str) -> Column:
    return F.when(m["n"] > 1, m[of] / (m["n"] - 1))


def _corr(a: State, b: State) -> Column:
    m = _merged(a, b)
    return _sample(m, "c") / F.nullif(F.sqrt(_sample(m, "qx")) * F.sqrt(_sample(m, "qy")), F.lit(0.0))


#: By function: its running state, and its value from the two states.
FUNCTIONS: dict[str, tuple[Callable[..., State], Callable[[State, State], Column]]] = {
    "ts_sum": (_sum_state, lambda a, b: _total(a, b)[0]),
    "ts_mean": (_sum_state, _mean),
    "ts_min": (lambda v, f, w: {"n": F.lit(0), "v": F.min(v[0]).over(w)}, lambda a, b: F.least(a["v"], b["v"])),
    "ts_max": (lambda v, f, w: {"n": F.lit(0), "v": F.max(v[0]).over(w)}, lambda a, b: F.greatest(a["v"], b["v"])),
    "ts_std": (_moments, lambda a, b: F.sqrt(_sample(_merged(a, b), "qx"))),
    "cov": (_moments, lambda a, b: _sample(_merged(a, b), "c")),
    "corr": (_moments, _corr),
}


def rolling(df: DataFrame, asked: dict[str, tuple[str, list[Column]]], n: int) -> DataFrame:
    """df with a column for each of asked: name of a function of FUNCTIONS and its one or two inputs, over the last n rows of the symbol."""
    inputs, columns = {}, df.columns
    for name, (_, args) in asked.items():
        paired = args if len(args) == 1 else [F.when(args[1].isNotNull(), args[0]), F.when(args[0].isNotNull(), args[1])]
        inputs |= {f"{name}_in{i}": v for i, v in enumerate(paired)}
    place = F.row_number().over(Window.partitionBy(SYMBOL).orderBy(DATE)) - 1
    out = df.withColumns({"__place": place, **inputs}).withColumn("__chunk", F.floor(F.col("__place") / n))
    for part, order in (("front", F.asc(DATE)), ("back", F.desc(DATE))):
        w = Window.partitionBy(SYMBOL, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({f"{c}_first": F.first(c, ignorenulls=True).over(w) for c in inputs})
        states = {}
        for name, (function, args) in asked.items():
            values = [F.col(f"{name}_in{i}") for i in range(len(args))]
            firsts = [F.col(f"{name}_in{i}_first") for i in range(len(args))]
            state = FUNCTIONS[function][0](values, firsts, w)
            states[f"{name}_{part}"] = F.struct(*[c.alias(k) for k, c in state.items()])
        out = out.withColumns(states)
    before = {f"{name}_before": F.lag(f"{name}_back", n - 1).over(Window.partitionBy(SYMBOL).orderBy(DATE)) for name in asked}
    out = out.withColumns(before)
    made = {}
    for name, (function, args) in asked.items():
        fields = FUNCTIONS[function][0]([F.lit(0.0)] * len(args), [F.lit(0.0)] * len(args), Window.partitionBy(SYMBOL))
        # at the end of a chunk the window is the chunk itself
        tail = (F.col("__place") + 1) % n != 0
        a = {k: F.col(f"{name}_front.{k}") for k in fields}
        b = {k: F.when(tail, F.col(f"{name}_before.{k}")) for k in fields}
        b["n"] = F.coalesce(b["n"], F.lit(0))
        made[name] = FUNCTIONS[function][1](a, b)
    return out.select(*columns, *[c.alias(name) for name, c in made.items()])


def rolling_rank(df: DataFrame, asked: dict[str, tuple[Column, int]]) -> DataFrame:
    """df with, for each of asked (an input and a window), the share of the window's values below the row's own, ties at their average place."""
    columns, inputs = df.columns, {f"{name}_in": v.cast("double") for name, (v, _) in asked.items()}
    sizes, names = [n for _, n in asked.values()], list(asked)
    dealt = df.withColumns(inputs).repartition(SYMBOL).sortWithinPartitions(SYMBOL, DATE)
    at = columns.index(SYMBOL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, held = object(), []
        for b in batches:
            of = b.column(at).to_pylist()
            made = [[] for _ in sizes]
            inputs = [b.column(len(columns) + i).to_pylist() for i in range(len(sizes))]
            for i, s in enumerate(of):
                if s != symbol:
                    symbol, held = s, [(deque(), []) for _ in sizes]
                for (last, ordered), n, values, out in zip(held, sizes, inputs, made, strict=True):
                    v = values[i]
                    if len(last) == n and (old := last.popleft()) is not None:
                        del ordered[bisect_left(ordered, old)]
                    last.append(v)
                    if v is None:
                        out.append(None)
                        continue
                    insort(ordered, v)
                    below = bisect_left(ordered, v)
                    same = bisect_right(ordered, v, below) - below
                    out.append((below + (same + 1) / 2) / len(ordered))
            arrays = [b.column(i) for i in range(len(columns))] + [pa.array(m, pa.float64()) for m in made]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return dealt.mapInArrow(run, kinds + "".join(f", `{name}` double" for name in names))
