"""Expressions as SQL text for DuckDB, written apart from the Spark compiler: the oracle of the tests."""

from __future__ import annotations

from barloom.plans.expressions import Node, parse

LINEITEM_BARS = """
SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS trade_date,
       first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
       sum(l_quantity) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM lineitem GROUP BY 1, 2"""
BARS = LINEITEM_BARS.format(unit="month")
WEEKS = LINEITEM_BARS.format(unit="week")
USER_DAYS = """
SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS trade_date, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
       min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2"""

EVENTS = """
SELECT CASE WHEN user_id % 3 = 0 THEN 'all' ELSE CAST(user_id AS VARCHAR) END AS symbol, event_id AS trade_date, value AS open, value AS high, value AS low, value AS close, 1.0::DOUBLE AS volume
FROM events"""


def no_nan(e: str) -> str:
    return f"(CASE WHEN NOT isnan({e}) THEN {e} END)"


def corr_sql(x: str, y: str, over: str = "") -> str:
    xm, ym = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"(covar_samp({xm}, {ym}){over} / nullif(stddev_samp({xm}){over} * stddev_samp({ym}){over}, 0))"


def expression_sql(expressions: dict[str, str], source: str, scope: str = "symbol", name: str = "panel") -> str:
    """WITH-list text (without WITH) that ends in a relation `name`: the source's columns and one for each expression."""
    trees = {k: parse(e) for k, e in expressions.items()}
    wanted: dict[Node, None] = {}
    for t in trees.values():
        for x in t.walk():
            if x.is_window:
                wanted.setdefault(x)
    cols: dict[Node, str] = {}
    part = {"symbol": "symbol", "date": "trade_date"}[scope]

    def sql(x: Node) -> str:
        if x in cols:
            return cols[x]
        a = [sql(y) for y in x.args]
        num = [f"CAST({s} AS DOUBLE)" if y.is_bool else s for s, y in zip(a, x.args, strict=True)]
        true = [s if y.is_bool else f"coalesce({s} <> 0, true)" for s, y in zip(a, x.args, strict=True)]
        if x.kind == "field":
            return x.name
        if x.kind == "const":
            return f"CAST({x.value!r} AS DOUBLE)"
        if x.kind == "neg":
            return f"(-{num[0]})"
        if x.kind == "cmp":
            o = {"==": "=", "!=": "<>"}.get(x.name, x.name)
            return f"coalesce({num[0]} {o} {num[1]}, {'true' if x.name == '!=' else 'false'})"
        if x.kind == "bool":
            return f"({true[0]} {x.name.upper()} {true[1]})"
        if x.kind == "op":
            if x.name == "/":
                return f"({num[0]} / nullif({num[1]}, 0))"
            if x.name == "**":
                return f"(CASE WHEN NOT ({num[0]} < 0 AND {num[1]} <> floor({num[1]})) THEN pow({num[0]}, {num[1]}) END)"
            return f"({num[0]} {x.name} {num[1]})"
        n, f = x.n, x.name
        order, last = f"OVER (PARTITION BY symbol ORDER BY trade_date", None
        last = f" {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" if n else ""
        lag = f"lag({num[0]}, {n}) {order})"
        whole = f" OVER (PARTITION BY {part})"
        if f == "where":
            return f"(CASE WHEN {true[0]} THEN {a[1] if x.is_bool else num[1]} ELSE {a[2] if x.is_bool else num[2]} END)"
        if f in ("delay", "delta", "ret"):
            return {"delay": lag, "delta": f"({num[0]} - {lag})", "ret": f"(({num[0]} - {lag}) / nullif({lag}, 0))"}[f]
        if f in ("ts_mean", "ts_sum", "ts_min", "ts_max", "ts_std"):
            return {"ts_mean": "avg", "ts_sum": "sum", "ts_min": "min", "ts_max": "max", "ts_std": "stddev_samp"}[f] + f"({num[0]})" + last
        if f == "ts_rank":
            v = f"list({num[0]}) FILTER ({num[0]} IS NOT NULL){last}"
            below, same = (f"len([v for v in {v} if v {o} {num[0]}])" for o in "<=")
            return f"(CASE WHEN {num[0]} IS NOT NULL THEN ({below} + ({same} + 1) / 2.0::DOUBLE) / len({v}) END)"
        if f == "corr":
            return corr_sql(num[0], num[1], last)
        if f == "cov":
            return f"covar_samp(CASE WHEN {num[1]} IS NOT NULL THEN {num[0]} END, CASE WHEN {num[0]} IS NOT NULL THEN {num[1]} END){last}"
        if f == "rank":
            return (
                f"(CASE WHEN {num[0]} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {num[0]} ASC NULLS LAST) + (count(*) OVER (PARTITION BY {part}, {num[0]}) - 1) / 2.0::DOUBLE)"
                f" / nullif(count({num[0]}){whole}, 0) END)"
            )
        sd, mean = f"stddev_samp({num[0]}){whole}", f"avg({num[0]}){whole}"
        if f == "zscore":
            return f"(CASE WHEN {sd} IS NULL OR {sd} = 0 THEN {num[0]} * 0 ELSE ({num[0]} - {mean}) / nullif({sd}, 0) END)"
        if f == "winsorize":
            k = x.value
            return f"(CASE WHEN {num[0]} IS NULL OR {sd} IS NULL OR {sd} = 0 THEN {num[0]} ELSE least(greatest({num[0]}, {mean} - {k} * {sd}), {mean} + {k} * {sd}) END)"
        two = f"CASE WHEN {num[0]} IS NOT NULL AND {num[-1]} IS NOT NULL THEN"
        return {
            "abs": lambda: f"abs({num[0]})", "sign": lambda: f"CAST(sign({num[0]}) AS DOUBLE)", "log1p": lambda: f"(ln(1 + abs({num[0]})) * sign({num[0]}))",
            "sqrt": lambda: f"(sqrt(abs({num[0]})) * sign({num[0]}))", "add": lambda: f"({num[0]} + {num[1]})", "sub": lambda: f"({num[0]} - {num[1]})",
            "mul": lambda: f"({num[0]} * {num[1]})", "div": lambda: f"({num[0]} / nullif({num[1]}, 0))", "min": lambda: f"({two} least({num[0]}, {num[1]}) END)",
            "max": lambda: f"({two} greatest({num[0]}, {num[1]}) END)",
            "clip": lambda: f"(CASE WHEN {num[0]} IS NOT NULL THEN least(greatest({num[0]}, {num[1]}), {num[2]}) END)",
        }[f]()

    ctes, before = [f"{name}_0 AS ({source})"], f"{name}_0"
    for i, level in enumerate(sorted({x.depth for x in wanted}), 1):
        here = {x: f"w{len(cols) + j}" for j, x in enumerate(w for w in wanted if w.depth == level)}
        ctes.append(f"{name}_{i} AS (SELECT *, {', '.join(f'{sql(x)} AS {c}' for x, c in here.items())} FROM {before})")
        cols.update(here)
        before = f"{name}_{i}"
    outs = ", ".join(f"CAST({sql(t)} AS DOUBLE) AS {k}" for k, t in trees.items())
    ctes.append(f"{name} AS (SELECT * EXCLUDE ({', '.join(cols.values())}), {outs} FROM {before})" if cols else f"{name} AS (SELECT *, {outs} FROM {before})")
    return ",\n".join(ctes)
