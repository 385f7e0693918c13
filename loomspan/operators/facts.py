"""Facts, snapshots and gates: normal form of analysis results, diffs with every outcome, suppressions, thresholds, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed order of the kinds of fact.
KINDS = ("file", "function", "call", "unresolved", "issue")
MAX_LEARNED = 200


def facts(kind: str, df: DataFrame, file: Column, line: Column, subject: Column, **payload: Column) -> DataFrame:
    """Rows as facts (kind, file, line, subject, payload)."""
    entries = [x for k, v in payload.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(F.lit(kind).alias("kind"), file.cast("string").alias("file"), line.cast("int").alias("line"), subject.cast("string").alias("subject"), (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("payload"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def replay(all_facts: DataFrame) -> DataFrame:
    """Counts by kind, every kind present, and the number of files."""
    kinds = all_facts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
    n = all_facts.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))
    return kinds.join(n, "kind", "left").fillna(0, ["n", "files"])


def without_position(all_facts: DataFrame) -> DataFrame:
    """Facts that need a file and have none."""
    return all_facts.where((F.col("kind") != "file") & (F.coalesce("file", F.lit("")) == ""))


def diff(base: DataFrame, current: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and status: added, removed, changed (some value differs, nulls being equal) or unchanged."""
    b = base.select(*keys, F.struct(*values).alias("b"), F.lit(True).alias("in_base"))
    c = current.select(*keys, F.struct(*values).alias("c"), F.lit(True).alias("in_current"))
    same = F.col("b").eqNullSafe(F.col("c"))
    status = F.when(F.col("in_base").isNull(), "added").when(F.col("in_current").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return b.join(c, keys, "full_outer").select(*keys, status.alias("status"))


def suppressed(alerts: DataFrame, suppressions: DataFrame, keys: list[str]) -> DataFrame:
    """Alerts without a suppression of equal keys; nulls are equal."""
    s = suppressions.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = reduce(lambda x, y: x & y, [alerts[k].eqNullSafe(s[f"__{k}"]) for k in keys])
    return alerts.join(s, same, "left_anti")


def new_and_fixed(base: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprints that are new in current, and those that are fixed."""
    new, fixed = suppressed(current, base, keys), suppressed(base, current, keys)
    return new.select(*keys, F.lit("new").alias("state")).distinct().unionByName(fixed.select(*keys, F.lit("fixed").alias("state")).distinct())


def gate(alerts: DataFrame, limits: dict[str, int], rule: str = "rule") -> DataFrame:
    """Every rule with a limit: its count, the limit and whether it is passed; also rules without an alert."""
    rules = alerts.sparkSession.createDataFrame(list(limits.items()), f"{rule} string, most long")
    n = alerts.groupBy(rule).agg(F.count("*").alias("n"))
    return rules.join(n, rule, "left").select(rule, F.coalesce("n", F.lit(0)).alias("n"), "most", (F.coalesce("n", F.lit(0)) > F.col("most")).alias("over"))


def latest(df: DataFrame, key: str, ts: str, tie: str, most: int | None = None) -> DataFrame:
    """The newest row of each key; of those the newest `most`."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)))
    kept = df.withColumn("__r", rank).where("__r = 1").drop("__r")
    return kept if most is None else kept.orderBy(F.desc(ts), F.desc(tie)).limit(most)


def rule_signature(alerts: DataFrame, group: str, rule: str) -> DataFrame:
    """A group's counts by rule as JSON in rule order."""
    n = alerts.groupBy(group, rule).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(rule, "n"))))).alias("signature"))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns as text, with nulls and lengths told apart."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def task_stats(tasks: DataFrame, kind: str = "kind", ms: str = "elapsed_ms", rolled_back: str = "rolled_back") -> DataFrame:
    """Per kind: count, roll-backs, and of times above 0 the truncated mean, the upper median and the maximum."""
    times = F.sort_array(F.collect_list(F.when(F.col(ms) > 0, F.col(ms))))
    out = tasks.groupBy(kind).agg(F.count("*").alias("n"), F.sum(F.col(rolled_back).cast("long")).alias("rollbacks"), F.avg(F.when(F.col(ms) > 0, F.col(ms))).cast("long").alias("avg_ms"), times.alias("t"))
    n = F.size("t")
    return out.select(kind, "n", "rollbacks", "avg_ms", F.get("t", F.floor(n / 2).cast("int")).alias("p50_ms"), F.get("t", n - 1).alias("max_ms"))


def against_baseline(stats: DataFrame, baseline: DataFrame, kind: str, factor: float) -> DataFrame:
    """Kinds whose median is at least factor times the baseline's (kind, base_ms)."""
    return stats.join(baseline, kind).withColumn("ratio", F.round(F.col("p50_ms") / F.col("base_ms"), 6)).where(F.col("p50_ms") >= factor * F.col("base_ms"))


def json_paths(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, value of a flat JSON object column."""
    m = F.from_json(column, "map<string,string>")
    return df.select(key, F.explode(m).alias("path", "value"))


def state_runs(lines: DataFrame, group: str, order: str, text: str, off: str, on: str) -> DataFrame:
    """lines with suppressed: inside a span opened by `off` and not yet closed by `on` in the same group."""
    state = F.when(F.col(text).rlike(off), F.lit(1)).when(F.col(text).rlike(on), F.lit(0))
    last = F.last(state, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("suppressed", F.coalesce(last == 1, F.lit(False)))


def undo_conflicts(edits: DataFrame, current: DataFrame) -> DataFrame:
    """What keeps edits (task, path, before, after: hashes) from being undone from the newest to the oldest: task, path, status.

    The newest edit of a path must have left what current (path, sha) has, each other one what the next newer began with.
    "gone": no such file; "changed": another content; "damaged": no old content to go back to.
    """
    newer = Window.partitionBy("path").orderBy(F.desc("task"))
    marked = edits.join(current.select("path", "sha"), "path", "left").withColumns({"__n": F.row_number().over(newer), "__left": F.lag("before").over(newer)})
    found = F.when(F.col("__n") == 1, F.col("sha")).otherwise(F.col("__left"))
    status = F.when(F.col("sha").isNull(), "gone").when(~found.eqNullSafe(F.col("after")), "changed").when(F.col("before").isNull(), "damaged")
    return marked.select("task", "path", status.alias("status")).where("status is not null")


def missing_keys(df: DataFrame, key: str, column: str, required: list[str]) -> DataFrame:
    """key and field for each required key that a JSON object lacks; a text that is no object lacks them all."""
    have = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    lacking = F.array_except(F.array(*map(F.lit, required)), have)
    return df.select(key, F.explode(lacking).alias("field"))
