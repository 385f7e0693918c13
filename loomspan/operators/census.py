"""Censuses over source-like rows: rates, ladders, conservation checks, memory sums, window marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ladder(rules: list[tuple[str, Column]], other: str) -> Column:
    """The name of the first rule that fits."""
    out = F.lit(other)
    for name, fits in reversed(rules):
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def flags_label(flags: list[tuple[str, Column]], none: str = "plain") -> Column:
    """The names of all flags that hold, joined by +."""
    joined = F.concat_ws("+", *(F.when(c, F.lit(n)) for n, c in flags))
    return F.when(joined == "", F.lit(none)).otherwise(joined)


def shares(df: DataFrame, label: str, order: str, sample: str) -> DataFrame:
    """label, n, pct of all (one digit), and the sample of the first row."""
    n = df.groupBy(label).agg(F.count("*").alias("n"), F.min_by(sample, order).alias("sample"))
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def coverage_rates(df: DataFrame, file: str, done: str, undone: str) -> DataFrame:
    """One row: the unweighted mean of per-file rates 1 - undone / (undone + done), files at 0.9 or more, files without any undone."""
    per = df.groupBy(file).agg(F.sum(done).alias("d"), F.sum(undone).alias("u"))
    rate = F.when(F.col("d") + F.col("u") == 0, 1.0).otherwise(1 - F.col("u") / F.when(F.col("d") + F.col("u") == 0, 1).otherwise(F.col("d") + F.col("u")))
    return per.agg(F.round(F.avg(rate), 6).alias("mean_rate"), F.count_if(rate >= 0.9).alias("good"), F.count_if(F.col("u") == 0).alias("clean"), F.count("*").alias("files"))


def sole_blockers(df: DataFrame, file: str, kind: str) -> DataFrame:
    """Per kind: files that it alone blocks, and files that it blocks at all."""
    kinds = df.select(file, kind).distinct()
    alone = kinds.groupBy(file).agg(F.count("*").alias("k"), F.min(kind).alias(kind)).where("k = 1").groupBy(kind).agg(F.count("*").alias("sole"))
    return kinds.groupBy(kind).agg(F.count("*").alias("any_file")).join(alone, kind, "left").fillna(0, ["sole"])


def marked_soon(lines: DataFrame, file: str, line: str, call: str, marker: str, ahead: int = 3) -> DataFrame:
    """Per file: calls, those whose own or one of the next `ahead` lines has the marker, and the ratio."""
    w = Window.partitionBy(file).orderBy(line).rowsBetween(0, ahead)
    seen = lines.withColumn("hit", F.bool_or(marker).over(w)).where(F.col(call))
    n = seen.groupBy(file).agg(F.count("*").alias("calls"), F.count_if("hit").alias("degraded"))
    return n.withColumn("ratio", F.round(F.col("degraded") / F.col("calls"), 6))


def feature_counts(texts: DataFrame, text: str, features: dict[str, str]) -> DataFrame:
    """Per feature (a regex): texts with a hit, and hits."""
    rows = F.array(*(F.struct(F.lit(k).alias("feature"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(v)).alias("n")) for k, v in features.items()))
    return texts.select(F.inline(rows)).groupBy("feature").agg(F.count_if(F.col("n") > 0).alias("texts"), F.sum("n").cast("long").alias("hits"))


def calibers(texts: DataFrame, text: str, word: str) -> DataFrame:
    """Hits of a string anywhere and as a whole word, and how many more the first has."""
    anywhere, whole = F.regexp_count(text, F.lit(word)), F.regexp_count(text, F.lit(rf"\b{word}\b"))
    return texts.agg(F.sum(anywhere).cast("long").alias("anywhere"), F.sum(whole).cast("long").alias("whole")).withColumn("delta", F.col("anywhere") - F.col("whole"))


def conservation(edges: DataFrame, sites: DataFrame, nodes: DataFrame, produced: tuple[str, ...]) -> DataFrame:
    """Checks of a graph whose edges (src, dst, kind) come from sites (outcome, n) over nodes (node): rule, expected, found, ok."""
    made = sites.where(F.col("outcome").isin(*produced)).agg(F.sum("n")).first()[0] or 0
    ids = nodes.select("node").distinct()
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    one = lambda rule, expected, df: df.select(F.lit(rule).alias("rule"), F.lit(expected).cast("long").alias("expected"), F.col("found").cast("long").alias("found"))
    rows = one("edges are produced sites", made, edges.agg(F.count("*").alias("found")))
    rows = rows.unionByName(one("edges end at nodes", 0, ends.join(ids, "node", "left_anti").agg(F.count("*").alias("found"))))
    rows = rows.unionByName(one("nodes are unique", 0, nodes.groupBy("node").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("found"))))
    return rows.withColumn("ok", F.col("expected") == F.col("found"))


def static_bytes(arrays: DataFrame, func: str, shape: str, width: int = 8) -> DataFrame:
    """Per function: bytes of all arrays of known shape, how many shapes are unknown."""
    size = F.aggregate(F.col(shape), F.lit(1).cast("long"), lambda a, n: a * n) * width
    return arrays.groupBy(func).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.count_if(F.col(shape).isNull()).alias("unknown"))


def first_section(arrays: DataFrame, size: Column, sections: list[tuple[str, int]]) -> DataFrame:
    """arrays with the first declared section that is large enough, whatever it holds already; null if none is."""
    return arrays.withColumn("section", ladder([(n, size <= most) for n, most in sections], "").cast("string")).withColumn("section", F.nullif("section", F.lit("")))


def signature_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """name, status and reasons from two lists (name, args, rets): matched, only_left, only_right or mismatched."""
    a = left.select("name", F.col("args").alias("la"), F.col("rets").alias("lr"), F.lit(True).alias("l"))
    b = right.select("name", F.col("args").alias("ra"), F.col("rets").alias("rr"), F.lit(True).alias("r"))
    reasons = F.filter(F.array(F.when(~F.col("la").eqNullSafe(F.col("ra")), "args"), F.when(~F.col("lr").eqNullSafe(F.col("rr")), "rets")), lambda x: x.isNotNull())
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    status = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(F.size(reasons) > 0, "mismatched").otherwise("matched")
    return a.join(b, "name", "full_outer").select("name", status.alias("status"), F.array_join(F.when(both, reasons).otherwise(F.array().cast("array<string>")), ",").alias("reasons"))


def parity(left: DataFrame, right: DataFrame, key: str, value: str, rel: float = 1e-9) -> DataFrame:
    """key and status of two result lists: identical, close (within rel of max(1, |right|)), mismatch, only_left, only_right."""
    a, b = left.select(key, F.col(value).alias("x"), F.lit(True).alias("l")), right.select(key, F.col(value).alias("y"), F.lit(True).alias("r"))
    near = F.abs(F.col("x") - F.col("y")) <= rel * F.greatest(F.lit(1.0), F.abs("y"))
    status = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(F.col("x").eqNullSafe(F.col("y")), "identical").when(near, "close").otherwise("mismatch")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def broken_links(steps: DataFrame, chain: str, order: str, taken: str, made: str) -> DataFrame:
    """Steps after a chain's first whose input no earlier step of the chain made."""
    first = F.min(order).over(Window.partitionBy(chain))
    earliest = steps.groupBy(F.col(chain).alias("__c"), F.col(made).alias("__m")).agg(F.min(order).alias("__o"))
    late = steps.withColumn("__first", first).where(F.col(order) > F.col("__first"))
    ok = (late[chain] == F.col("__c")) & (late[taken] == F.col("__m")) & (F.col("__o") < late[order])
    return late.join(earliest, ok, "left_anti").select(chain, order, taken)


def call_chain_bytes(own: DataFrame, calls: DataFrame) -> DataFrame:
    """own (node, bytes) with total: its bytes and those of all that it calls (src, dst), each as often as it is called.

    Totals are null for nodes on cycles and for all that reach one: what trimming from the leaves never frees.
    """
    from .graph import cut

    calls = cut(calls.join(own.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy("src", "dst").agg(F.count("*").alias("m")))
    ready = cut(own.join(calls.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node", F.col("bytes").alias("total")))
    done, open_nodes = ready, cut(own.join(ready, "node", "left_anti").select("node", "bytes"))
    while not ready.isEmpty() and not open_nodes.isEmpty():
        known = calls.join(done.select(F.col("node").alias("dst"), "total"), "dst", "left").groupBy(F.col("src").alias("node"))
        sums = known.agg(F.sum(F.col("m") * F.col("total")).alias("below"), F.count_if(F.col("total").isNull()).alias("waiting")).where("waiting = 0")
        ready = cut(open_nodes.join(sums, "node").select("node", (F.col("bytes") + F.col("below")).alias("total")))
        done, open_nodes = cut(done.unionByName(ready)), cut(open_nodes.join(ready, "node", "left_anti"))
    return done.unionByName(open_nodes.select("node", F.lit(None).cast("long").alias("total")))
