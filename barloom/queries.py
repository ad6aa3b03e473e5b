"""The registered queries of the panel engine, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import panel as pn
from barloom.config import DedupConfig, FactorConfig, PortfolioConfig, QualityConfig
from barloom.library import SEEDS, Factor, seed_factors
from barloom.operators import backtest as bt
from barloom.operators import metrics as mt
from barloom.operators import neighbours as nb
from barloom.operators import quality as ql
from barloom.operators import ranks as rk
from barloom.operators import scoring as sc
from barloom.operators.boundary import SampleBoundary
from barloom.plans.compiler import evaluate_all, with_expressions
from barloom.plans.expressions import FIELDS, complexity, parse
from barloom.plans.increment import KeptValues, with_warm_up
from barloom.plans.slices import look_back, with_slices
from barloom.plans.sql import BARS, EVENTS, USER_DAYS, WEEKS, corr_sql, expression_sql
from barloom.shared import new_path, written
from barloom.sources import datasets as ds
from barloom.sources.checked import Checked, load_checked
from barloom.sources.committed import ResultSet
from barloom.sources.panels import bars_events, bars_lineitem, bars_user_day
from barloom.sources.readers import DataRequest, FileSource, apply_request, preview

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BOUNDS = SampleBoundary("1995-01-01", "1998-12-31", "1999-01-01", "2001-12-31")
SEED_EXPRESSIONS = {f.factor_id: f.expression for f in seed_factors()}
SEED_PAIRS = {f.factor_id: (f.expression, f.direction) for f in seed_factors()}
#: Differences above it fail the truncation test.
TOLERANCE = QualityConfig().truncation_max_diff
BAR_COLUMNS = ["symbol", "trade_date", *FIELDS]
#: Ranges of the registered rank within dates.
RANGES = 200
#: Portfolio of the registered back-tests.
PORTFOLIO = PortfolioConfig(rebalance="weekly")


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def months(spark: SparkSession, d: str) -> DataFrame:
    return bars_lineitem(spark, d)


def rounded(df: DataFrame, places: int = 8, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if k == "double" and c not in skip else F.col(c) for c, k in df.dtypes])


def r(e: str, name: str, places: int = 8) -> str:
    return f"round({e}, {places}) AS {name}"


def bars_sql(where: str = "", source: str = BARS) -> str:
    return f"WITH p AS ({source}) SELECT {', '.join(BAR_COLUMNS)} FROM p {where}"


# --- sources, filters


add("src_panel_months", lambda s, d: months(s, d).select(*BAR_COLUMNS), bars_sql())
add("src_panel_weeks", lambda s, d: bars_lineitem(s, d, "week").select(*BAR_COLUMNS), bars_sql(source=WEEKS))
add("src_panel_user_days", lambda s, d: bars_user_day(s, d), USER_DAYS)


def src_normalized(s: SparkSession, d: str) -> DataFrame:
    """Orders under vendor headers, brought to the panel contract."""
    raw = s.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_custkey").alias(" TS_Code "), F.date_format("o_orderdate", "yyyyMMdd").alias("Trade_Date"), *[F.col("o_totalprice").alias(c) for c in pn.PRICES], F.lit("7").alias("VOL")
    )
    return pn.normalize(raw)


add("src_normalized", src_normalized, """SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS trade_date, o_totalprice AS open, o_totalprice AS high, o_totalprice AS low,
o_totalprice AS close, 7.0::DOUBLE AS volume, 'CN' AS market, 'UNKNOWN' AS exchange FROM orders""")


def _filtered(**kw) -> Query:
    return lambda s, d: apply_request(months(s, d), DataRequest(**kw)).select(*[c for c in BAR_COLUMNS if not kw.get("fields") or c in ("symbol", "trade_date", *kw["fields"])])


add("flt_date_range", _filtered(start_date="1996-02-01", end_date="1997-06-30"), bars_sql("WHERE trade_date BETWEEN DATE '1996-02-01' AND DATE '1997-06-30'"))
add("flt_symbols_in", _filtered(symbols=["1", "3", "5", "7", "404"]), bars_sql("WHERE symbol IN ('1', '3', '5', '7', '404')"))
add("prj_fields", _filtered(fields=["close"]), f"WITH p AS ({BARS}) SELECT symbol, trade_date, close FROM p")
add("flt_train_split", lambda s, d: BOUNDS.train(months(s, d)).select(*BAR_COLUMNS), bars_sql(f"WHERE trade_date BETWEEN DATE '{BOUNDS.train_start}' AND DATE '{BOUNDS.train_end}'"))
add("flt_oos_split", lambda s, d: BOUNDS.oos(months(s, d)).select(*BAR_COLUMNS), bars_sql(f"WHERE trade_date BETWEEN DATE '{BOUNDS.oos_start}' AND DATE '{BOUNDS.oos_end}'"))
add(
    "flt_leakage_rows", lambda s, d: months(s, d).agg(F.count_if(BOUNDS.is_oos()).alias("oos_rows"), F.count_if(BOUNDS.is_train()).alias("train_rows"), F.count_if(BOUNDS.is_oos() & BOUNDS.is_train()).alias("in_both")),
    f"""WITH p AS ({BARS}), q AS (SELECT trade_date BETWEEN DATE '{BOUNDS.oos_start}' AND DATE '{BOUNDS.oos_end}' AS o, trade_date BETWEEN DATE '{BOUNDS.train_start}' AND DATE '{BOUNDS.train_end}' AS t FROM p)
SELECT count(*) FILTER (o) AS oos_rows, count(*) FILTER (t) AS train_rows, count(*) FILTER (o AND t) AS in_both FROM q""",
)
add("top_preview", lambda s, d: preview(months(s, d).orderBy("symbol", "trade_date"), 50).select(*BAR_COLUMNS), bars_sql("ORDER BY symbol, trade_date LIMIT 50"))


def src_roundtrip(fmt: str) -> Query:
    """Bars written as text in the shared folder and read back by the panel's file source."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = new_path(s, f"bars.{fmt}")
        bars = months(s, d).select(*BAR_COLUMNS)
        bars.write.option("header", True).csv(path) if fmt == "csv" else bars.write.json(path)
        return FileSource((f".{fmt}",)).load(s, DataRequest(path)).select(*BAR_COLUMNS)

    return run


add("src_csv_roundtrip", src_roundtrip("csv"), bars_sql())
add("src_json_roundtrip", src_roundtrip("json"), bars_sql())


def src_checked(s: SparkSession, d: str) -> Checked:
    """Bars written as JSON Lines of which some are spoilt, by a rule on symbol and month, and read back with a side table."""
    bars = months(s, d).select(*BAR_COLUMNS)
    rule = F.pmod(F.col("symbol").cast("int") * 31 + F.month("trade_date"), F.lit(20))
    text = bars.withColumns({"trade_date": F.col("trade_date").cast("string"), "close": F.col("close").cast("string")})
    spoilt = {"symbol": F.when(rule == 3, "").otherwise(F.col("symbol")), "trade_date": F.when(rule == 2, "1995-13-40").otherwise(F.col("trade_date")), "close": F.when(rule == 0, "n/a").otherwise(F.col("close"))}
    line = F.to_json(F.struct(*[spoilt.get(c, F.col(c)).alias(c) for c in BAR_COLUMNS]))
    path = new_path(s, "spoilt.jsonl")
    text.withColumn("rule", rule).select(F.when(F.col("rule") == 1, line.substr(F.lit(1), F.length(line) - 1)).otherwise(line).alias("value")).write.text(path)
    return load_checked(s, DataRequest(path), most=1.0)


_RULE = "(CAST(symbol AS INTEGER) * 31 + month(trade_date)) % 20"
add("src_checked_good", lambda s, d: src_checked(s, d).good.select(*BAR_COLUMNS), bars_sql(f"WHERE {_RULE} > 3"))
add(
    "src_checked_rejected", lambda s, d: src_checked(s, d).rejected.select(F.regexp_extract("record", '"symbol":"([^"]*)"', 1).alias("symbol"), F.regexp_extract("record", '"trade_date":"([^"]*)"', 1).alias("day"), "reason"),
    f"""WITH p AS ({BARS}), q AS (SELECT symbol, strftime(trade_date, '%Y-%m-%d') AS day, {_RULE} AS k FROM p)
SELECT CASE WHEN k = 3 THEN '' ELSE symbol END AS symbol, CASE WHEN k = 2 THEN '1995-13-40' ELSE day END AS day,
CASE k WHEN 0 THEN 'unreadable close' WHEN 1 THEN 'malformed record' WHEN 2 THEN 'unreadable trade_date' ELSE 'no symbol' END AS reason FROM q WHERE k <= 3""",
)


def snk_committed(s: SparkSession, d: str) -> DataFrame:
    """Two committed versions of a result set and a third that was never finished; the second is what is read."""
    results = ResultSet(s, new_path(s, "results"))
    bars = months(s, d).select(*BAR_COLUMNS)
    results.commit({"bars": bars.limit(0)})
    results.commit({"bars": bars})
    bars.limit(0).write.parquet(f"{results.root}/data/000000003-unfinished/bars")
    return results.table("bars")


add("snk_committed", snk_committed, bars_sql())


# --- validation

add(
    "val_profile", lambda s, d: pn.profile_row(months(s, d)).select(F.col("rows").alias("n_rows"), "n_symbols", "start_date", "end_date", "duplicate_keys"),
    f"WITH p AS ({BARS}) SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) - count(DISTINCT (symbol, trade_date)) AS duplicate_keys FROM p",
)
GAPPY = "with_gaps"


def with_gaps(s: SparkSession, d: str) -> DataFrame:
    """Months in which prices that end high are missing, for checks of missing and odd values."""
    p = months(s, d)
    return p.withColumns({"close": F.when(F.col("close") < 1500, F.col("close")), "volume": F.col("volume") - 50, "high": F.when(F.col("open") > 1200, F.col("low") - 1).otherwise(F.col("high"))})


GAPS = f"SELECT symbol, trade_date, open, CASE WHEN open > 1200 THEN low - 1 ELSE high END AS high, low, CASE WHEN close < 1500 THEN close END AS close, volume - 50 AS volume, amount FROM ({BARS})"
add(
    "val_missing_rates", lambda s, d: rounded(pn.profile_row(with_gaps(s, d)).select(*[F.col(f"missing_{c}").alias(c) for c in BAR_COLUMNS])),
    f"SELECT {', '.join(f'round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END), 8) AS {c}' for c in BAR_COLUMNS)} FROM ({GAPS})",
)
add(
    "val_dup_keys", lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("symbol"), F.col("l_linenumber").alias("trade_date")).transform(lambda df: df.agg(pn.duplicate_keys(df).alias("duplicate_rows"))),
    "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicate_rows FROM lineitem",
)
add(
    "val_nonpositive", lambda s, d: pn.validation_row(with_gaps(s, d)).select(*[F.col(f"low_{c}").alias(c) for c in (*pn.PRICES, "volume")]),
    f"SELECT {', '.join(f'count(*) FILTER ({c} <= 0) AS {c}' for c in pn.PRICES)}, count(*) FILTER (volume < 0) AS volume FROM ({GAPS})",
)
_BAD = "open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND (high < greatest(open, low, close) OR low > least(open, high, close))"
add("val_ohlc_logic", lambda s, d: with_gaps(s, d).where(pn.bad_bar()).select("symbol", "trade_date"), f"SELECT symbol, trade_date FROM ({GAPS}) WHERE {_BAD}")
add(
    "val_ohlc_anomaly", lambda s, d: ds.check_row(with_gaps(s, d)).select(F.col("d").alias("duplicate_keys"), F.col("a").alias("anomalies"), F.col("b").alias("bad_bars")),
    f"SELECT count(*) - count(DISTINCT (symbol, trade_date)) AS duplicate_keys, count(*) FILTER (high < low OR high < open) AS anomalies, count(*) FILTER ({_BAD}) AS bad_bars FROM ({GAPS})",
)
add(
    "val_dataset_meta",
    lambda s, d: s.createDataFrame([ds.metadata(bars_user_day(s, d))], "rows long, n_symbols long, start_date string, end_date string").withColumnRenamed("rows", "n_rows"),
    f"SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, strftime(min(trade_date), '%Y-%m-%d') AS start_date, strftime(max(trade_date), '%Y-%m-%d') AS end_date FROM ({USER_DAYS})",
)

# --- the expression language

EXPRESSIONS = {
    "ts_delay": "delay(close, 3)", "ts_delta": "delta(close, 2)", "ts_ret": "ret(close, 5)", "ts_mean": "ts_mean(close, 12)", "ts_sum": "ts_sum(volume, 12)",
    "ts_std": "ts_std(close, 12)", "ts_min": "ts_min(low, 12)", "ts_max": "ts_max(high, 12)", "ts_rank": "ts_rank(close, 12)", "ts_corr": "corr(close, volume, 12)",
    "ts_cov": "cov(ret(close, 1), ret(open, 1), 12)",
    "fn_abs": "abs(sub(close, open))", "fn_sign": "sign(sub(close, open))", "fn_log1p": "log1p(sub(close, open))", "fn_sqrt": "sqrt(sub(close, open))",
    "fn_clip": "clip(close, 1000, 1400)", "fn_add": "add(close, open)", "fn_sub": "sub(close, open)", "fn_mul": "mul(close, 2)", "fn_div": "div(close, sub(high, low))",
    "fn_min": "min(close, delay(close, 1))", "fn_max": "max(close, delay(close, 1))", "fn_where": "where(ret(close, 1) > 0, high, low)",
    "op_arith": "(close - open) / (high - low) + volume * 2", "op_pow": "((close - open) / close) ** 2 + close ** 0.5", "op_unary": "-close + +open",
    "op_compare": "(close > open) + (close >= delay(close, 1)) * 2 + (close != open) * 4 + (low == close) * 8 + (low < open) * 16 + (close <= high) * 32",
    "op_bool": "where(close > open and volume > 100 or high == low, 1, 0)", "op_pow_undefined": "(close - open) ** 0.5",
}
SCOPED = {"cs_rank": "rank(close)", "cs_zscore": "zscore(ret(close, 1))", "cs_winsorize": "winsorize(ret(close, 1), 1)"}


def expression_query(e: str, scope: str = "symbol", source: Callable[[SparkSession, str], DataFrame] = months) -> Query:
    return lambda s, d: rounded(with_expressions(source(s, d), {"value": e}, scope).select("symbol", "trade_date", "value"))


def expression_oracle(e: str, scope: str = "symbol", source: str = BARS) -> str:
    return f"WITH {expression_sql({'value': e}, source, scope)} SELECT symbol, trade_date, {r('value', 'value')} FROM panel"


for _name, _e in EXPRESSIONS.items():
    add(_name, expression_query(_e), expression_oracle(_e))
for _name, _e in SCOPED.items():
    for _scope in ("symbol", "date"):
        add(f"{_name}_{_scope}", expression_query(_e, _scope), expression_oracle(_e, _scope))
add("cs_rank_date_ranges", lambda s, d: rounded(rk.rank_by_range(written(months(s, d).select("symbol", "trade_date", "close"), "closes"), ["trade_date"], "close", "value", RANGES).select("symbol", "trade_date", "value")), expression_oracle("rank(close)", "date"))
add("ts_gaps_user_days", expression_query("ts_mean(ret(close, 1), 5)", source=bars_user_day), expression_oracle("ts_mean(ret(close, 1), 5)", source=USER_DAYS))
add("ts_missing_values", expression_query("ts_std(close, 6)", source=with_gaps), expression_oracle("ts_std(close, 6)", source=GAPS))
SLICED = "div(sub(close, ts_mean(close, 100)), add(ts_std(delay(close, 3), 80), 1)) + ts_rank(close, 90) + corr(close, delay(close, 1), 70)"
add("ts_slices_events", lambda s, d: rounded(with_slices(bars_events(s, d), {"value": SLICED}).select("symbol", "trade_date", "value")), expression_oracle(SLICED, source=EVENTS))
for _i, (_n, _l, _e, _d) in enumerate(SEEDS, 1):
    add(f"factor_{_i:03d}", expression_query(_e), expression_oracle(_e))


def factor_all_long(s: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate_all(months(s, d), SEED_PAIRS), 6)


def long_sql(source: str = BARS, name: str = "v") -> str:
    """CTEs that end in name: factor_id, symbol, trade_date, forward_return, factor_value of all built-in factors."""
    panel = expression_sql(SEED_EXPRESSIONS, source)
    fwd = "lead(close, 1) OVER (PARTITION BY symbol ORDER BY trade_date) / nullif(close, 0) - 1"
    one = " UNION ALL ".join(f"SELECT '{f}' AS factor_id, symbol, trade_date, forward_return, {f} * {SEED_PAIRS[f][1]} AS factor_value FROM pf" for f in SEED_EXPRESSIONS)
    return f"{panel}, pf AS MATERIALIZED (SELECT *, {fwd} AS forward_return FROM panel), {name} AS MATERIALIZED ({one})"


add("factor_all_long", factor_all_long, f"WITH {long_sql()} SELECT factor_id, symbol, trade_date, {r('factor_value', 'factor_value', 6)} FROM v")

#: Batches of dates that kept values are built from.
BATCHES = ["1994-12-31", "1996-06-30", "1998-01-31", "9999-12-31"]
KEPT = {"a": "div(sub(close, ts_mean(close, 12)), add(ts_std(delay(close, 2), 9), 1))", "b": "ts_rank(volume, 7)", "c": "corr(close, delay(close, 1), 8)"}


def kept_values(s: SparkSession, d: str) -> DataFrame:
    """Values of all dates, put together from batches of which each knows the tails before it only."""
    p, kept, after = months(s, d), KeptValues(s, new_path(s, "kept"), KEPT), "0001-01-01"
    for until in BATCHES:
        kept.append(p.where((F.col("trade_date") > F.lit(after).cast("date")) & (F.col("trade_date") <= F.lit(until).cast("date"))))
        after = until
    return rounded(kept.values())


add("kept_values", kept_values, f"WITH {expression_sql(KEPT, BARS)} SELECT symbol, trade_date, {', '.join(r(c, c) for c in KEPT)} FROM panel")


def oos_warm(s: SparkSession, d: str) -> DataFrame:
    """Out-of-sample values of the built-in factors that look back, warmed up by the train period's last rows."""
    p = months(s, d)
    wide = with_warm_up(p.where(F.col("trade_date") < F.lit(BOUNDS.oos_start).cast("date")), BOUNDS.oos(p), {f: e for f, e in SEED_EXPRESSIONS.items() if f in WARM})
    return rounded(wide.select("symbol", "trade_date", *WARM), 6)


WARM = [f for f, e in SEED_EXPRESSIONS.items() if look_back(parse(e)) is not None]
add("oos_warm", oos_warm, f"""WITH {expression_sql({f: SEED_EXPRESSIONS[f] for f in WARM}, f"SELECT * FROM ({BARS}) WHERE trade_date <= DATE '{BOUNDS.oos_end}'")}
SELECT symbol, trade_date, {', '.join(r(f, f, 6) for f in WARM)} FROM panel WHERE trade_date >= DATE '{BOUNDS.oos_start}'""")

# --- the registry's texts


CANDIDATE_FUNCTIONS, CANDIDATE_FIELDS = ("ts_mean", "TS_STD", "ts_max", "ts_Min", "delta"), ("close", "Open", "high")


def _candidates(s: SparkSession, d: str) -> DataFrame:
    """A candidate expression for every order, written from its values; some differ from others in spacing and case alone."""
    pick = lambda names, c: F.get(F.array(*map(F.lit, names)), (F.col(c) % len(names)).cast("int"))
    whole = lambda c: c.cast("long").cast("string")
    gap = F.when(F.col("o_orderstatus") == "O", F.lit(" , ")).otherwise(F.lit(","))
    text = F.concat(pick(CANDIDATE_FUNCTIONS, "o_custkey"), F.lit("("), pick(CANDIDATE_FIELDS, "o_custkey"), gap, whole(F.col("o_orderkey") % 20 + 2), F.lit(") / "), whole(F.floor(F.col("o_totalprice") / 10_000)), F.lit(" - 1"))
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("f"), whole(F.col("o_orderkey"))).alias("factor_id"), text.alias("expression"))


def _candidates_sql() -> str:
    pick = lambda names, c: f"list_extract([{', '.join(map(repr, names))}], CAST({c} % {len(names)} AS INTEGER) + 1)"
    gap = "CASE WHEN o_orderstatus = 'O' THEN ' , ' ELSE ',' END"
    text = f"{pick(CANDIDATE_FUNCTIONS, 'o_custkey')} || '(' || {pick(CANDIDATE_FIELDS, 'o_custkey')} || {gap} || (o_orderkey % 20 + 2) || ') / ' || CAST(floor(o_totalprice / 10000) AS BIGINT) || ' - 1'"
    return f"""WITH f AS (SELECT o_orderkey AS pos, 'f' || o_orderkey AS factor_id, {text} AS expression FROM orders),
h AS (SELECT *, sha256(regexp_replace(lower(expression), '\\s+', '', 'g')) AS expression_hash FROM f)"""


add("expr_hash", lambda s, d: sc.structural_duplicates(_candidates(s, d)).select("factor_id", "expression_hash"), f"{_candidates_sql()} SELECT factor_id, expression_hash FROM h")
add("dedup_structural", lambda s, d: sc.structural_duplicates(_candidates(s, d)).where("is_first").select("factor_id", "expression"),
    f"{_candidates_sql()} SELECT factor_id, expression FROM h QUALIFY row_number() OVER (PARTITION BY expression_hash ORDER BY pos) = 1")

# --- evaluation


def values(s: SparkSession, d: str, part: str = "all", through: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All built-in factors in long form with the forward return, computed within the period. No factor has two values of a symbol on one date; through
    as in evaluate_all."""
    p = months(s, d)
    p = {"all": lambda: p, "train": lambda: BOUNDS.train(p), "oos": lambda: BOUNDS.oos(p)}[part]()
    return evaluate_all(mt.with_forward_return(p), SEED_PAIRS, keep=("forward_return",), through=through)


TRAIN, OOS = (f"SELECT * FROM ({BARS}) WHERE trade_date BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in ((BOUNDS.train_start, BOUNDS.train_end), (BOUNDS.oos_start, BOUNDS.oos_end)))


#: Registered ranks take values that agree in so many significant digits as ties: two correlations of +1 differ by the order of a sum, which
#: differs between engines. Rows named raw rank values as they are, for the factors without correlations.
TIES = 9
WITHOUT_CORR = [f for f, e in SEED_EXPRESSIONS.items() if "corr(" not in e]


def tied_sql(x: str) -> str:
    scale = f"pow(10.0::DOUBLE, {TIES - 1} - floor(log10(abs({x}))))"
    return f"CASE WHEN abs({x}) BETWEEN 1e-290 AND 1e290 THEN round_even({x} * {scale}, 0) / {scale} ELSE {x} END"


def wide_written(df: DataFrame) -> DataFrame:
    """Values that are read several times: written before they become long, a row for each symbol and date."""
    return written(df, "values")


def raw_values(s: SparkSession, d: str, through: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    return values(s, d, through=through).where(F.col("factor_id").isin(WITHOUT_CORR))


RAW = f"raw AS (SELECT * FROM v WHERE factor_id IN ({', '.join(map(repr, WITHOUT_CORR))}))"


def metrics(s: SparkSession, d: str, part: str = "all") -> DataFrame:
    return mt.all_metrics(values(s, d, part, wide_written), digits=TIES, unique=True)


def _ranked(x: str) -> str:
    return f"rank() OVER (PARTITION BY factor_id, trade_date ORDER BY {x}) + (count(*) OVER (PARTITION BY factor_id, trade_date, {x}) - 1) / 2.0::DOUBLE"


def ic_sql(v: str = "v", out: str = "ic", ranked: Callable[[str], str] = tied_sql) -> str:
    return f"""{out}_p AS (SELECT * FROM {v} WHERE factor_value IS NOT NULL AND forward_return IS NOT NULL),
{out}_q AS (SELECT *, {ranked('factor_value')} AS x FROM {out}_p),
{out}_r AS (SELECT *, {_ranked('x')} AS rx, {_ranked('forward_return')} AS ry FROM {out}_q),
{out} AS (SELECT factor_id, trade_date, {corr_sql('factor_value', 'forward_return')} AS ic, {corr_sql('rx', 'ry')} AS rankic, count(*) AS n FROM {out}_r GROUP BY 1, 2 HAVING count(*) >= 5)"""


def summary_sql(ic: str = "ic", out: str = "m") -> str:
    return f"""{out} AS (SELECT factor_id, avg(ic) AS ic_mean, CASE WHEN count(*) > 1 THEN stddev_samp(ic) ELSE 0 END AS ic_std, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0) AS icir,
avg(rankic) AS rankic_mean, CASE WHEN count(*) > 1 THEN stddev_samp(rankic) ELSE 0 END AS rankic_std, coalesce(avg(rankic) / nullif(stddev_samp(rankic), 0), 0) AS rankicir,
count(*) AS n_valid_dates, count(*) FILTER (ic > 0) / count(*)::DOUBLE AS positive_ic_ratio,
coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0) * sqrt(252.0) AS annualized_icir, coalesce(avg(rankic) / nullif(stddev_samp(rankic), 0), 0) * sqrt(252.0) AS annualized_rank_icir
FROM {ic} GROUP BY 1)"""


def turnover_sql(v: str = "v", out: str = "t", ranked: Callable[[str], str] = tied_sql) -> str:
    return f"""{out}_h AS (SELECT factor_id, trade_date, symbol, {ranked('avg(factor_value)')} AS x FROM {v} WHERE factor_value IS NOT NULL GROUP BY ALL),
{out}_r AS (SELECT *, ({_ranked('x')}) / count(*) OVER (PARTITION BY factor_id, trade_date) AS r, dense_rank() OVER (PARTITION BY factor_id ORDER BY trade_date) AS i FROM {out}_h),
{out}_d AS (SELECT factor_id, symbol, CASE WHEN lag(i) OVER w = i - 1 THEN abs(r - lag(r) OVER w) END AS c FROM {out}_r WINDOW w AS (PARTITION BY factor_id, symbol ORDER BY i)),
{out} AS (SELECT factor_id, coalesce(avg(c), 0) AS turnover FROM (SELECT factor_id, symbol, avg(c) AS c FROM {out}_d GROUP BY 1, 2) GROUP BY 1)"""


def cover_sql(v: str = "v", out: str = "c") -> str:
    return f"{out} AS (SELECT factor_id, avg(CASE WHEN factor_value IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM {v} GROUP BY 1)"


METRICS = ["ic_mean", "ic_std", "icir", "rankic_mean", "rankic_std", "rankicir", "positive_ic_ratio", "annualized_icir", "annualized_rank_icir"]


def metrics_sql(source: str, tag: str = "") -> str:
    """CTEs that end in a{tag}: all metrics of all factors over a source."""
    cols = ", ".join(f"CASE WHEN m{tag}.n_valid_dates IS NULL THEN 0 ELSE {c} END AS {c}" for c in METRICS)
    body = long_sql(source, f"v{tag}")
    if tag:
        body = body.replace("panel", f"panel{tag}").replace("pf", f"pf{tag}")
    return f"""{body}, {ic_sql(f'v{tag}', f'ic{tag}')}, {summary_sql(f'ic{tag}', f'm{tag}')}, {turnover_sql(f'v{tag}', f't{tag}')}, {cover_sql(f'v{tag}', f'c{tag}')},
a{tag} AS (SELECT factor_id, {cols}, CASE WHEN n_valid_dates IS NULL THEN 0 ELSE coverage END AS coverage, CASE WHEN n_valid_dates IS NULL THEN 0 ELSE turnover END AS turnover,
coalesce(n_valid_dates, 0) AS n_valid_dates FROM c{tag} LEFT JOIN t{tag} USING (factor_id) LEFT JOIN m{tag} USING (factor_id))"""


ALL_METRICS = [*METRICS, "coverage", "turnover"]
_rounds = lambda cols, p=6: ", ".join(r(c, c, p) for c in cols)

add("fwd_return", lambda s, d: rounded(mt.with_forward_return(months(s, d)).select("symbol", "trade_date", "forward_return")),
    f"SELECT symbol, trade_date, {r('lead(close) OVER (PARTITION BY symbol ORDER BY trade_date) / nullif(close, 0) - 1', 'forward_return')} FROM ({BARS})")
add("daily_ic", lambda s, d: rounded(mt.daily_ic(values(s, d), TIES).select("factor_id", "trade_date", "ic", "n")), f"WITH {long_sql()}, {ic_sql()} SELECT factor_id, trade_date, {r('ic', 'ic')}, n FROM ic")
add("daily_rankic", lambda s, d: rounded(mt.daily_ic(values(s, d), TIES).select("factor_id", "trade_date", "rankic", "n")), f"WITH {long_sql()}, {ic_sql()} SELECT factor_id, trade_date, {r('rankic', 'rankic')}, n FROM ic")
add("icir_summary", lambda s, d: rounded(mt.ic_summary(mt.daily_ic(values(s, d), TIES)), 6), f"WITH {long_sql()}, {ic_sql()}, {summary_sql()} SELECT factor_id, n_valid_dates, {_rounds(METRICS)} FROM m")
add("coverage", lambda s, d: rounded(mt.coverage(values(s, d))), f"WITH {long_sql()}, {cover_sql()} SELECT factor_id, {r('coverage', 'coverage')} FROM c")
add("rank_turnover", lambda s, d: rounded(mt.rank_turnover(values(s, d, through=wide_written), TIES, unique=True)), f"WITH {long_sql()}, {turnover_sql()} SELECT factor_id, {r('turnover', 'turnover')} FROM t")
add("daily_rankic_raw", lambda s, d: rounded(mt.daily_ic(raw_values(s, d)).select("factor_id", "trade_date", "rankic", "n")),
    f"WITH {long_sql()}, {RAW}, {ic_sql('raw', ranked=str)} SELECT factor_id, trade_date, {r('rankic', 'rankic')}, n FROM ic")
add("daily_rankic_ranges", lambda s, d: rounded(rk.daily_rankic(raw_values(s, d, wide_written))), f"WITH {long_sql()}, {RAW}, {ic_sql('raw', ranked=str)} SELECT factor_id, trade_date, {r('rankic', 'rankic')}, n FROM ic")
add("rank_turnover_raw", lambda s, d: rounded(mt.rank_turnover(raw_values(s, d, wide_written), unique=True)), f"WITH {long_sql()}, {RAW}, {turnover_sql('raw', ranked=str)} SELECT factor_id, {r('turnover', 'turnover')} FROM t")
add("metrics_all", lambda s, d: rounded(metrics(s, d), 6), f"WITH {metrics_sql(BARS)} SELECT factor_id, n_valid_dates, {_rounds(ALL_METRICS)} FROM a")

# --- scoring, deduplication, out-of-sample


def scored(s: SparkSession, d: str) -> DataFrame:
    return sc.classify(sc.composite_score(metrics(s, d, "train")))


def score_sql() -> str:
    c = FactorConfig()
    share = lambda m: f"(CASE WHEN count(*) OVER () = 1 THEN 0.5 WHEN {m} IS NULL THEN 0 ELSE percent_rank() OVER (ORDER BY {m} ASC NULLS LAST) END)"
    total = " + ".join(share(m) for m in sc.SCORED)
    reach = lambda score, least: " AND ".join([f"composite_score >= {score}", *(f"{m} >= {v}" for m, v in zip(sc.SCORED, least, strict=True))])
    return f"""{metrics_sql(TRAIN)}, s AS (SELECT *, ({total}) / 4 AS composite_score FROM a),
k AS (SELECT *, CASE WHEN {reach(c.elite_score_threshold, c.least("elite"))} THEN 'elite' WHEN {reach(c.qualified_score_threshold, c.least("qualified"))} THEN 'qualified' ELSE 'rejected' END AS status FROM s)"""


add("composite_score", lambda s, d: rounded(scored(s, d).select("factor_id", "composite_score")), f"WITH {score_sql()} SELECT factor_id, {r('composite_score', 'composite_score')} FROM k")
add("classify", lambda s, d: scored(s, d).select("factor_id", "status"), f"WITH {score_sql()} SELECT factor_id, status FROM k")
add("status_counts", lambda s, d: sc.status_counts(scored(s, d)), f"WITH {score_sql()} SELECT status, count(*) AS n FROM k GROUP BY 1")
add("elite_factors", lambda s, d: scored(s, d).where("status = 'elite'").select("factor_id"), f"WITH {score_sql()} SELECT factor_id FROM k WHERE status = 'elite'")
add("factor_daily_mean", lambda s, d: rounded(sc.daily_means(values(s, d, "train")), 6), f"WITH {long_sql(TRAIN)} SELECT factor_id, trade_date, {r('avg(factor_value)', 'mean_value', 6)} FROM v GROUP BY 1, 2")
PAIRS = f"""mean AS (SELECT factor_id, trade_date, avg(factor_value) AS x FROM v GROUP BY 1, 2 HAVING avg(factor_value) IS NOT NULL),
pairs AS (SELECT l.factor_id AS a, r.factor_id AS b, {corr_sql('l.x', 'r.x')} AS correlation, count(*) AS n_dates FROM mean l JOIN mean r ON l.trade_date = r.trade_date AND l.factor_id < r.factor_id GROUP BY 1, 2)"""
add("factor_corr_pairs", lambda s, d: rounded(sc.correlation_pairs(sc.daily_means(values(s, d, "train"))), 6), f"WITH {long_sql(TRAIN)}, {PAIRS} SELECT a, b, {r('correlation', 'correlation', 6)}, n_dates FROM pairs")


def dedup_numerical(s: SparkSession, d: str) -> DataFrame:
    v = values(s, d, "train", wide_written)
    info = {x["factor_id"]: {"score": x["composite_score"], "coverage": x["coverage"], "turnover": x["turnover"], "length": len(SEED_EXPRESSIONS[x["factor_id"]])} for x in sc.composite_score(mt.all_metrics(v, digits=TIES, unique=True)).collect()}
    kept, removed = sc.numerical_dedup(list(SEED_EXPRESSIONS), sc.correlation_pairs(sc.daily_means(v)), info)
    return s.createDataFrame([(f, True) for f in kept] + [(f, False) for f in removed], "factor_id string, kept boolean")


def dedup_sql() -> str:
    """The walk over the factors as a recursive query: one step for each, with the places of those removed so far."""
    listed = ", ".join(f"({i}, '{f}', {len(e)})" for i, (f, e) in enumerate(SEED_EXPRESSIONS.items()))
    return f"""WITH RECURSIVE {score_sql()}, {PAIRS},
f AS (SELECT pos, factor_id, row_number() OVER (ORDER BY composite_score DESC, length, coverage DESC, turnover, pos) AS place FROM (VALUES {listed}) t(pos, factor_id, length) JOIN s USING (factor_id)),
near AS (SELECT l.pos, list({{'place': r.place, 'pos': r.pos}}) AS found FROM f l JOIN f r ON l.pos = r.pos
OR (l.pos < r.pos AND EXISTS (SELECT 1 FROM pairs WHERE abs(correlation) >= 0.85 AND a = least(l.factor_id, r.factor_id) AND b = greatest(l.factor_id, r.factor_id))) GROUP BY 1),
walk AS (SELECT 0 AS pos, []::INTEGER[] AS removed UNION ALL
SELECT pos + 1, CASE WHEN list_contains(removed, pos) THEN removed ELSE list_concat(removed, [g.pos for g in left_over if g.pos <> list_min(left_over).pos]) END
FROM (SELECT w.pos, removed, [g for g in found if NOT list_contains(removed, g.pos)] AS left_over FROM walk w JOIN near USING (pos)))
SELECT factor_id, NOT list_contains(removed, f.pos) AS kept FROM f, walk w WHERE w.pos = (SELECT count(*) FROM f)"""


add("dedup_numerical", dedup_numerical, dedup_sql())


def dedup_rounds(s: SparkSession, d: str) -> DataFrame:
    """The same walk in rounds, over pairs that come from blocks."""
    v = values(s, d, "train", wide_written)
    scored = sc.composite_score(mt.all_metrics(v, digits=TIES, unique=True)).select("factor_id", F.col("composite_score").alias("score"), "coverage", "turnover")
    listed = s.createDataFrame([(f, i, len(e)) for i, (f, e) in enumerate(SEED_EXPRESSIONS.items())], "factor_id string, pos int, length int")
    return nb.keep_best(listed.join(scored, "factor_id"), nb.close_pairs(sc.daily_means(v), DedupConfig().absolute_correlation_threshold))


add("factor_corr_blocks", lambda s, d: rounded(nb.close_pairs(sc.daily_means(values(s, d, "train"))), 6), f"WITH {long_sql(TRAIN)}, {PAIRS} SELECT a, b, {r('correlation', 'correlation', 6)}, n_dates FROM pairs")
add("dedup_numerical_rounds", dedup_rounds, dedup_sql())


def oos(s: SparkSession, d: str) -> DataFrame:
    return sc.oos_pairing(metrics(s, d, "train"), metrics(s, d, "oos"))


OOS_SQL = f"""{metrics_sql(TRAIN, '_tr')}, {metrics_sql(OOS, '_oo')}, o AS (SELECT a_oo.*, coalesce(a_tr.ic_mean, 0) AS train_ic, coalesce(a_oo.ic_mean, 0) AS oos_ic FROM a_oo JOIN a_tr USING (factor_id))"""
add("oos_metrics", lambda s, d: rounded(oos(s, d).select("factor_id", "n_valid_dates", *ALL_METRICS), 6), f"WITH {OOS_SQL} SELECT factor_id, n_valid_dates, {_rounds(ALL_METRICS)} FROM o")
add("oos_decay", lambda s, d: rounded(oos(s, d).select("factor_id", "train_ic", "oos_ic", "decay_ratio"), 6),
    f"WITH {OOS_SQL} SELECT factor_id, {_rounds(['train_ic', 'oos_ic'])}, {r('coalesce((train_ic - oos_ic) / nullif(abs(train_ic), 0), 0)', 'decay_ratio', 6)} FROM o")
add("oos_sign", lambda s, d: oos(s, d).select("factor_id", "sign_consistent"), f"WITH {OOS_SQL} SELECT factor_id, (train_ic >= 0) = (oos_ic >= 0) AS sign_consistent FROM o")

# --- back-test of one factor (midterm_momentum) on the whole panel

BT_EXPRESSION = SEED_EXPRESSIONS["seed_010"]


def index_bars(s: SparkSession, d: str) -> DataFrame:
    """Month bars as an index of the logarithm of prices, whose returns compound to readable numbers."""
    return months(s, d).withColumn("close", 100 + F.ln("close"))


INDEX = f"SELECT symbol, trade_date, open, high, low, 100 + ln(close) AS close, volume, amount FROM ({BARS})"


def bt_values(s: SparkSession, d: str) -> DataFrame:
    p = bt.with_daily_return(with_expressions(index_bars(s, d), {"factor_value": BT_EXPRESSION}))
    return p.select("symbol", "trade_date", "factor_value", "daily_return")


BT = f"""{expression_sql({'factor_value': BT_EXPRESSION}, INDEX)},
q AS MATERIALIZED (SELECT symbol, trade_date, factor_value, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS daily_return FROM panel),
days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM (SELECT DISTINCT trade_date FROM q)),
reb AS (SELECT * FROM days WHERE i % 5 = 0),
h AS (SELECT q.*, row_number() OVER (PARTITION BY trade_date ORDER BY factor_value DESC, symbol) AS place, count(*) OVER (PARTITION BY trade_date) AS n FROM q JOIN reb USING (trade_date) WHERE factor_value IS NOT NULL),
z AS (SELECT *, greatest(floor(n * 0.2::DOUBLE), 1) AS k FROM h)"""
WEIGHT = {
    "top_quantile": "SELECT trade_date, symbol, least(1 / k, 0.05::DOUBLE) AS weight FROM z WHERE place <= k",
    "bottom_quantile": "SELECT trade_date, symbol, least(1 / k, 0.05::DOUBLE) AS weight FROM z WHERE place > n - k",
    "long_short": "SELECT trade_date, symbol, CASE WHEN place > n - k THEN -least(1 / k, 0.05::DOUBLE) ELSE least(1 / k, 0.05::DOUBLE) END AS weight FROM z WHERE place <= k OR place > n - k",
    "equal_weight": "SELECT trade_date, symbol, 1.0::DOUBLE / n AS weight FROM z",
}
SHORT = {"top_quantile": "top", "bottom_quantile": "bottom", "long_short": "long_short", "equal_weight": "equal"}


def port_sql(strategy: str) -> str:
    return f"""{BT}, w AS ({WEIGHT[strategy]}),
g AS (SELECT trade_date, coalesce(sum(daily_return * weight), 0) AS gross FROM q JOIN w USING (trade_date, symbol) GROUP BY 1),
x AS (SELECT trade_date, sum(abs(weight)) * 0.0015::DOUBLE AS cost FROM w GROUP BY 1),
n AS (SELECT trade_date, gross, coalesce(cost, 0) AS cost, gross - coalesce(cost, 0) AS net FROM g LEFT JOIN x USING (trade_date)),
u AS (SELECT *, product(1 + net) OVER (ORDER BY trade_date) - 1 AS cumulative FROM n),
y AS (SELECT *, cumulative - max(cumulative) OVER (ORDER BY trade_date) AS drawdown FROM u),
wd AS (SELECT w.*, dense_rank() OVER (ORDER BY trade_date) AS i FROM w),
mv AS (SELECT i, symbol, sum(weight) AS c FROM (SELECT i, symbol, weight FROM wd UNION ALL SELECT i + 1, symbol, -weight FROM wd) GROUP BY 1, 2),
tv AS (SELECT coalesce(avg(m), 0) AS turnover FROM (SELECT i, sum(abs(c)) / 2 AS m FROM mv GROUP BY 1) WHERE i > 1 AND i <= (SELECT max(i) FROM wd))"""


def _parts(s: SparkSession, d: str, strategy: str) -> tuple[DataFrame, DataFrame]:
    v = bt_values(s, d)
    return v, bt.build_weights(v, strategy, PORTFOLIO)


add("rebalance_dates", lambda s, d: bt.rebalance_dates(months(s, d), "weekly").select("trade_date", F.col("i").cast("long").alias("i")), f"WITH {BT} SELECT trade_date, i FROM reb")
for _st in bt.STRATEGIES:
    add(f"weights_{SHORT[_st]}", lambda s, d, st=_st: rounded(_parts(s, d, st)[1]), f"WITH {port_sql(_st)} SELECT trade_date, symbol, {r('weight', 'weight')} FROM w")


def port(strategy: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return bt.daily_returns(*_parts(s, d, strategy), PORTFOLIO)

    return run


_daily = lambda *cols: (lambda s, d: rounded(port("long_short")(s, d).select("trade_date", *cols)))
for _name, _col in (("port_returns", "gross"), ("port_costs", "cost"), ("port_cumulative", "cumulative"), ("port_drawdown", "drawdown")):
    add(_name, _daily(_col), f"WITH {port_sql('long_short')} SELECT trade_date, {r(_col, _col)} FROM y")
add("port_turnover", lambda s, d: rounded(bt.portfolio_turnover(_parts(s, d, "long_short")[1])), f"WITH {port_sql('long_short')} SELECT {r('turnover', 'turnover')} FROM tv")


def port_summary(strategy: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        v, w = _parts(s, d, strategy)
        return rounded(bt.summary(bt.daily_returns(v, w, PORTFOLIO), w))

    return run


def summary_port_sql(strategy: str) -> str:
    return f"""WITH {port_sql(strategy)}, s AS (SELECT count(*) AS n_days, arg_max(cumulative, trade_date) AS total, stddev_samp(net) * sqrt(252.0) AS annual_volatility, min(drawdown) AS max_drawdown,
sum(cost) AS total_cost, product(1 + gross) - 1 AS gross_return FROM y), b AS (SELECT *, CASE WHEN 1 + total >= 0 THEN pow(1 + total, 252.0::DOUBLE / n_days) - 1 END AS annual_return FROM s)
SELECT n_days, {r('coalesce(annual_return, 0)', 'annual_return')}, {r('annual_volatility', 'annual_volatility')}, {r('coalesce(max_drawdown, 0)', 'max_drawdown')}, {r('coalesce(total_cost, 0)', 'total_cost')},
{r('coalesce(total, 0)', 'return_after_cost')}, {r('coalesce(total, 0)', 'return_before_cost')}, {r('coalesce(gross_return, 0)', 'gross_return')},
{r('coalesce(annual_return / nullif(annual_volatility, 0), 0)', 'sharpe_ratio')}, {r('coalesce(annual_return / nullif(abs(max_drawdown), 0), 0)', 'calmar_ratio')}, {r('turnover', 'turnover')} FROM b, tv"""


for _st in bt.STRATEGIES:
    add(f"port_summary_{SHORT[_st]}", port_summary(_st), summary_port_sql(_st))



def port_prices(strategy: str) -> Query:
    """The days of a back-test on the months' own prices. Their returns compound beyond what a fixed number of places can hold, so growth is
    given as a logarithm (none where all is lost)."""

    def run(s: SparkSession, d: str) -> DataFrame:
        v = bt.with_daily_return(with_expressions(months(s, d), {"factor_value": BT_EXPRESSION})).select("symbol", "trade_date", "factor_value", "daily_return")
        days = bt.daily_returns(v, bt.build_weights(v, strategy, PORTFOLIO), PORTFOLIO)
        left = F.col("cumulative") + 1
        return rounded(days.select("trade_date", "gross", "cost", F.when(left > 0, F.ln(left)).alias("growth")), 6)

    return run


for _st in bt.STRATEGIES:
    add(f"port_prices_{SHORT[_st]}", port_prices(_st), f"WITH {port_sql(_st).replace(INDEX, BARS)} SELECT trade_date, {_rounds(['gross', 'cost'])}, {r('CASE WHEN cumulative + 1 > 0 THEN ln(cumulative + 1) END', 'growth', 6)} FROM y")

# --- quality gate


def q_stats(s: SparkSession, d: str) -> DataFrame:
    """What the gate learns of the values of all built-in factors."""
    c = QualityConfig()
    near = F.coalesce(F.col("sd") < c.near_constant_threshold, F.lit(False))
    return ql.value_stats(months(s, d), SEED_EXPRESSIONS, "symbol", c).select("factor_id", F.col("valid").alias("valid_ratio"), F.col("inf").alias("has_inf"), near.alias("near_constant"))


_Q = f"WITH {long_sql()} SELECT factor_id, "
add("q_valid_ratio", lambda s, d: rounded(q_stats(s, d).select("factor_id", "valid_ratio")), _Q + r("avg(CASE WHEN factor_value IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END)", "valid_ratio") + " FROM v GROUP BY 1")
add("q_inf", lambda s, d: q_stats(s, d).select("factor_id", "has_inf"), _Q + "coalesce(bool_or(isinf(factor_value)), false) AS has_inf FROM v GROUP BY 1")
add("q_near_constant", lambda s, d: q_stats(s, d).select("factor_id", "near_constant"), _Q + f"coalesce(stddev_samp(factor_value) FILTER (NOT isinf(factor_value)) < {QualityConfig().near_constant_threshold}, false) AS near_constant FROM v GROUP BY 1")


def q_complexity(s: SparkSession, d: str) -> DataFrame:
    return _candidates(s, d).select("factor_id", ql.complexity_of(F.col("expression")).alias("complexity"))


add("q_complexity", q_complexity, f"{_candidates_sql()} SELECT factor_id, length(expression) - length(translate(expression, '(+-*/', '')) AS complexity FROM h")


TEST_DATES = QualityConfig().truncation_test_dates


def truncation(expressions: dict[str, str]) -> Query:
    """Values at ten dates, with and without the later rows."""

    def run(s: SparkSession, d: str) -> DataFrame:
        p = written(months(s, d), "bars")
        out = ql.truncation_test(p, expressions, ql.truncation_dates(p, TEST_DATES, seed=None))
        return rounded(out.select("factor_id", "trade_date", "n", "max_diff", "correlation", (F.col("max_diff") > TOLERANCE).alias("leaks")), 6)

    return run


def truncation_sql(expressions: dict[str, str]) -> str:
    """Every date has a copy of all rows up to it, under symbols of its own."""
    dates = f"""days AS MATERIALIZED (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () - {ql.LEAST_DATES} AS n FROM (SELECT DISTINCT trade_date FROM ({BARS}))),
dates AS MATERIALIZED (SELECT trade_date AS d FROM days WHERE i IN (SELECT {ql.LEAST_DATES} + (j * n) // least({TEST_DATES}, n) FROM range({TEST_DATES}) t(j), (SELECT max(n) AS n FROM days) WHERE j < least({TEST_DATES}, n)))"""
    cut = f"SELECT b.symbol || '|' || d AS symbol, b.symbol AS of_symbol, d, b.trade_date, open, high, low, close, volume, amount FROM ({BARS}) b JOIN dates ON b.trade_date <= d"
    one = (
        "SELECT '{f}' AS factor_id, l.trade_date, count(*) AS n, round(max(abs(l.{f} - r.{f})), 6) AS max_diff, round({corr}, 6) AS correlation, max(abs(l.{f} - r.{f})) > {most} AS leaks "
        "FROM whole l JOIN cut r ON l.symbol = r.of_symbol AND l.trade_date = r.trade_date WHERE r.trade_date = r.d AND l.{f} IS NOT NULL AND r.{f} IS NOT NULL GROUP BY 2 HAVING count(*) >= 2"
    )
    ends = [one.format(f=f, most=TOLERANCE, corr=corr_sql(f"l.{f}", f"r.{f}")) for f in expressions]
    return f"WITH {dates}, {expression_sql(expressions, BARS, name='whole')}, {expression_sql(expressions, cut, name='cut')} " + " UNION ALL ".join(ends)


TS_SEEDS = {f: e for f, e in SEED_EXPRESSIONS.items() if f not in ("seed_021",)}
RANK_SEED = {"seed_021": SEED_EXPRESSIONS["seed_021"]}
add("q_truncation_ts", truncation(TS_SEEDS), truncation_sql(TS_SEEDS))
add("q_truncation_rank", truncation(RANK_SEED), truncation_sql(RANK_SEED))


def gated() -> list[Factor]:
    """All built-in factors and all that must be rejected."""
    return seed_factors() + [Factor(n, n, e, description="a factor that must be rejected") for n, e in ql.BAD_FACTORS.items()]


def q_gate(s: SparkSession, d: str) -> DataFrame:
    """The whole gate over all built-in and all bad factors, with test dates at even steps."""
    out = ql.check_all(gated(), written(months(s, d), "bars"), seed=None)
    return s.createDataFrame([(x.factor_id, x.passed, x.stage, x.complexity) for x in out], "factor_id string, passed boolean, stage string, complexity long")


def gate_sql() -> str:
    """Texts judged by patterns, values by aggregates, look-ahead by the truncation rows; the first check that fails names the stage."""
    c = QualityConfig()
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    listed = ", ".join(f"({quoted(f.factor_id)}, {quoted(f.expression)}, {len(f.description.strip())})" for f in gated())
    text = f"expression LIKE '%shift(%' OR regexp_matches(expression, '(delay|delta|ret)\\([a-z]+, -[0-9]') OR list_max([x::BIGINT for x in regexp_extract_all(expression, '[0-9]+')]) > {c.max_window_size}"
    odd = f"valid < {c.min_valid_ratio} OR 1 - valid > {c.max_nan_ratio} OR valid = 0 OR inf OR coalesce(sd < {c.near_constant_threshold}, false)"
    stats = f"WITH {long_sql()} SELECT factor_id, avg(CASE WHEN factor_value IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS valid, coalesce(bool_or(isinf(factor_value)), false) AS inf, stddev_samp(factor_value) FILTER (NOT isinf(factor_value)) AS sd FROM v GROUP BY 1"
    return f"""WITH f(factor_id, expression, told) AS (VALUES {listed}),
st AS (SELECT * FROM ({stats})), tr AS (SELECT factor_id, max(max_diff) AS most, min(correlation) AS least, bool_or(leaks) AS leaks FROM ({truncation_sql(SEED_EXPRESSIONS)}) GROUP BY 1),
j AS (SELECT f.*, length(expression) - length(translate(expression, '(+-*/', '')) AS complexity, valid, inf, sd, leaks, least FROM f LEFT JOIN st USING (factor_id) LEFT JOIN tr USING (factor_id)),
g AS (SELECT factor_id, complexity, CASE WHEN {text} THEN 'dsl_whitelist' WHEN {odd} THEN 'nan_constant' WHEN told < 10 THEN 'economic_logic'
WHEN leaks OR least < {c.truncation_min_corr} THEN 'truncation' WHEN complexity > {c.max_complexity} THEN 'complexity' ELSE '' END AS stage FROM j)
SELECT factor_id, stage = '' AS passed, stage, complexity FROM g"""


add("q_gate", q_gate, gate_sql())
assert all(complexity(e) and parse(e) for e in SEED_EXPRESSIONS.values())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in factors scored on one panel in one job."""
    return QUERIES["metrics_all"](spark, sf_dir)
