"""Secret scans with an incremental blob ledger.

Every historical version of every path is content-addressed by the SHA-256 of its text. The ledger is a
table of (blob, rules it was scanned with, findings); a scan takes only pairs of blob and rule version that
the ledger lacks, so a text that a thousand paths share is read once, and a new rule version reads each
blob once more for that rule alone. Findings are joined back to all paths by their blob.

Spans come from SQL string functions alone: the texts between matches (split) and the matches themselves
(regexp_extract_all) give each match's start as a running sum of lengths, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stage, stage_path


@dataclass(frozen=True)
class Rule:
    """pattern is matched leftmost, without overlaps; a match stays if `least` code points of group `group` are there."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hint: str = ""  # a cheaper pattern that every text with a match also matches
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, then kinds added by this library. Ledgers of assign@1 lack texts whose names end in capitals.
BASE = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, r"(?i:(?:pass|secret|token|key)[a-z]*)[\"']?\x20*[:=]", 3),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
]
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, "PRIVATE KEY"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0, r"eyJ"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, r"gh[pousr]_"),
]
RULES = BASE + MORE

FINDING = "struct<rule:string,start:long,end:long>"
#: Matches whose places are summed up together.
PART = 256


def spans(text: Column, rule: Rule) -> Column:
    """array<FINDING> of one rule in one text."""
    nothing = F.array().cast(f"array<{FINDING}>")
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    told = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    # a long text may hold a hundred thousand matches that fail: the sum of lengths runs over them once
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(found))
    steps = F.zip_with(gaps, F.zip_with(found, told, lambda m, g: F.struct(F.char_length(m).alias("m"), F.char_length(g).alias("g"))), lambda gap, m: F.struct(F.char_length(gap).alias("gap"), m.alias("m")))
    steps = F.transform(steps, lambda x: F.struct((x["gap"] + x["m"]["m"]).cast("long").alias("on"), x["m"]["m"].cast("long").alias("m"), (x["m"]["g"] >= rule.least).alias("stays")))
    return F.when(text.rlike(rule.hint) if rule.hint else F.lit(True), F.flatten(F.transform(F.array(steps), lambda x: _placed(x, rule, nothing)))).otherwise(nothing)


def _placed(steps: Column, rule: Rule, nothing: Column) -> Column:
    """The findings of steps (on: how far a match ends after the one before). Running sums go by parts of PART matches, each with its own
    array, so that no long array is copied for every finding."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(steps) / PART).cast("int") - 1, F.lit(0))), lambda i: F.slice(steps, i * PART + 1, PART))
    ahead = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at:long,part:array<struct<on:long,m:long,stays:boolean>>>>").alias("out"))

    def begin(acc: Column, part: Column) -> Column:
        total = F.aggregate(part, acc["at"], lambda at, x: at + x["on"])
        return F.struct(total.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), part.alias("part")))).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["on"]
        one = F.array(F.struct(F.lit(rule.key).alias("rule"), (end - x["m"]).alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["stays"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    within = lambda p: F.aggregate(p["part"], F.struct(p["at"].alias("at"), nothing.alias("out")), add, lambda acc: acc["out"])
    return F.flatten(F.transform(F.aggregate(parts, ahead, begin, lambda acc: acc["out"]), within))


def scan(docs: DataFrame, rules: list[Rule] = RULES, ledger: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, blob, findings (array of kind, start, end; kind counts rules from 0).

    ledger: a Parquet folder that all executors reach; what it has is not scanned again, what is scanned is
    appended. Without one a fresh ledger is made in the shared folder. Null texts are the empty blob.
    Rows with a null id, repeated rows and ties are paths like any other; long texts are scanned whole, however many findings they have;
    other columns are not read, whatever their names; an empty table gives no rows. Kinds are stored in the ledger by
    name and version, so rules may be reordered, added or raised to a new version between runs.
    """
    spark = docs.sparkSession
    ledger = ledger or stage_path(spark, "ledger")
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(doc_id).alias("__id"), body.alias("__body"), F.sha2(body, 256).alias("blob"))
    paths = stage(source.select("__id", "blob"), "paths")
    blobs = paths.groupBy("blob").agg(F.min("__id").alias("__rep"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    known = _read_ledger(spark, ledger)
    if known is not None:
        seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("__seen"))
        blobs = blobs.join(seen, "blob", "left").select("blob", "__rep", F.array_except(wanted, F.coalesce("__seen", F.array().cast("array<string>"))).alias("todo"))
    else:
        blobs = blobs.select("blob", "__rep", wanted.alias("todo"))
    todo = stage(blobs.where(F.size("todo") > 0).withColumnRenamed("blob", "__blob"), "todo")
    due = source.join(todo, F.col("__id").eqNullSafe(F.col("__rep")) & (F.col("blob") == F.col("__blob")))
    named = []
    for r in rules:
        got = spans(F.col("__body"), r)
        named.append(F.when(F.array_contains("todo", r.key), got).otherwise(F.array().cast(f"array<{FINDING}>")))
    due.select("blob", F.col("todo").alias("scanned"), F.concat(*named).alias("findings")).write.mode("append").parquet(ledger)

    # blobs without findings need no row in the join; repeated scans of a blob count once
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    hits = _read_ledger(spark, ledger).where(F.size("findings") > 0)
    if known is not None:  # an older ledger holds blobs of other runs, too
        hits = hits.join(paths.select("blob"), "blob", "left_semi")
    hits = hits.select("blob", F.explode("findings").alias("f"))
    hits = hits.select("blob", F.struct(F.col("f.start").alias("start"), order[F.col("f.rule")].alias("kind"), F.col("f.end").alias("end")).alias("f")).where("f.kind is not null")
    hits = stage(hits.groupBy("blob").agg(F.array_sort(F.collect_set("f")).alias("findings")).withColumnRenamed("blob", "__blob"), "hits")
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    return paths.join(hits, F.col("blob") == F.col("__blob"), "left").select(F.col("__id").alias(doc_id), "blob", F.coalesce("findings", none).alias("findings"))


def _read_ledger(spark, path: str) -> DataFrame | None:
    """The ledger, or None where there is none yet."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return None
    return spark.read.schema("blob string, scanned array<string>, findings array<" + FINDING + ">").parquet(path)


def rendered(findings: Column, rules: list[Rule], only: set[str] | None = None) -> Column:
    """kind:start:end of all findings (or those of some kinds), comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    if only is not None:
        wanted = [i for i, r in enumerate(rules) if r.kind in only]
        findings = F.filter(findings, lambda f: f["kind"].isin(wanted))
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", F.get(names, f["kind"]), f["start"].cast("string"), f["end"].cast("string"))), ",")
