"""Mixing sources to target weights by entropy balancing.

Each word of a document is mass one. Among all reweightings that give each source its target, entropy balancing takes that
closest to the corpus in relative entropy: documents are tilted by exp(lambda of their source). The lambdas solve a convex dual
(log of the tilted mass, less the targets' inner product); its gradient and Hessian are sums over documents, so each
Newton iteration is one distributed aggregation over a histogram of sizes, and only a row a source reaches the driver.

Rates are then rounded into copies. Documents of a source are taken in descending size. Those above a thousandth of their
source (fewer than a thousand) are rounded one by one, each making up for the error so far; all others, by the rate that the
rest of the target asks of them, get copies by their rank: floor(rate * rank + 1/2) less that of the rank before. As sizes
descend, the error of a source stays below one such document. Ranks come from sums over the histogram and a count within a
(source, size, salt) group, so no source and no group of copies meets in one task.

Defined cases: a null text has size 0 and is taken 0 times its size; a null source is a source of its own, the last; ties are
broken by doc_id and the text's hash, and equal rows share their copies in any way, with the same rows out; a corpus
without words has targets 0; an empty table gives no row; other columns don't matter.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
#: A group of equal sizes of a source is dealt out to so many.
SALTS = 64
#: Documents above 1 / LARGE of their source are rounded one by one.
LARGE = 1000
TOLERANCE = 1e-12
ITERATIONS = 60


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Each source's target: shares by weight of all sizes, none above most times its own size, the excess reshared."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    found, free, left = {}, list(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not above:
            return found | {s: left * weight[s] / total for s in free}
        for s in above:
            found[s] = float(most * sizes[s])
        free = [s for s in free if s not in found]
        left = float(sum(sizes.values())) - sum(found.values())
    return found


def balance(hist: DataFrame, target: dict[str | None, float]) -> dict[str | None, float]:
    """The rate of each source with a target above 0, from Newton's method on the dual; hist: source, size, n."""
    spark = hist.sparkSession
    names = [s for s, t in target.items() if t > 0]
    if not names:
        return {}
    total = sum(target.values())
    lam = dict.fromkeys(names, 0.0)

    def masses(at: dict[str | None, float]) -> dict[str | None, float]:
        tilt = spark.createDataFrame(list(at.items()), "source string, lam double")
        tilted = hist.join(tilt, hist["source"].eqNullSafe(tilt["source"])).select(hist["source"], (F.col("n") * F.col("size") * F.exp("lam")).alias("mass"))
        return {r["source"]: r["mass"] for r in tilted.groupBy("source").agg(F.sum("mass").alias("mass")).collect()}

    def value(mass: dict[str | None, float], at: dict[str | None, float]) -> float:
        return math.log(sum(mass.values())) - sum(target[s] / total * at[s] for s in names)

    mass = masses(lam)
    for _ in range(ITERATIONS):
        z = sum(mass.values())
        gap = {s: mass[s] / z - target[s] / total for s in names}
        if max(abs(gap[s]) / (target[s] / total) for s in names) < TOLERANCE:
            break
        # H = diag(p) - p p', so H d = -g has the solution d = -g / p up to a constant, which changes nothing
        step = {s: -gap[s] / (mass[s] / z) for s in names}
        decrement = sum(gap[s] * step[s] for s in names)
        scale = 1.0
        while True:  # a source's mass at a shorter step follows from this one's, so the search needs no pass
            new = {s: lam[s] + scale * step[s] for s in names}
            if value({s: mass[s] * math.exp(scale * step[s]) for s in names}, new) <= value(mass, lam) + 0.25 * scale * decrement or scale < 1e-6:
                break
            scale /= 2
        lam, mass = new, masses(new)
    z = sum(mass.values())
    return {s: math.exp(lam[s]) * total / z for s in names}


def _round_large(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of a source's large documents, in descending size; each makes up for the error so far."""
    pdf = pdf.sort_values("size", ascending=False)
    wanted, taken, rows = 0.0, 0, []
    for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"], strict=True):
        copies = []
        for _ in range(int(n)):
            wanted += rate * size
            c = min(MOST, max(0, math.floor((wanted - taken) / size + 0.5)))
            copies.append(c)
            taken += c * int(size)
        rows.append((int(size), copies, int(sum(copies) * size)))
    out = pd.DataFrame(rows, columns=["size", "copies", "large_taken"])
    out.insert(0, "source", pdf["source"].iloc[0])
    return out


def with_copies(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source and others) with __size, __source_size, __target and __copies."""
    spark = docs.sparkSession
    ship(spark)
    marked = docs.withColumns(
        {
            "__source": F.col("source").cast("string"),
            "__size": F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long"),
            "__hash": F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        }
    ).withColumn("__salt", F.pmod("__hash", F.lit(SALTS)).cast("int"))
    salted = written(marked.groupBy(F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__salt").alias("salt")).agg(F.count("*").alias("n")), "sizes")
    hist = written(salted.groupBy("source", "size").agg(F.sum("n").alias("n")), "histogram")
    sizes = {r["source"]: r["s"] for r in hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("s")).collect()}  # a row a source
    target = targets(sizes)
    rate = balance(hist, target)
    of_source = spark.createDataFrame([(s, sizes[s], target[s], rate.get(s, 0.0)) for s in sizes], "source string, source_size long, target double, rate double")

    def joined(left: DataFrame, right: DataFrame, *names: str, how: str = "left") -> DataFrame:
        right = right.select(*(F.col(n).alias(f"_{n}") for n in names), *(c for c in right.columns if c not in names))
        on = left[names[0]].eqNullSafe(right[f"_{names[0]}"])
        for n in names[1:]:
            on = on & (left[n] == right[f"_{n}"])
        return left.join(right, on, how).drop(*(f"_{n}" for n in names))

    hist = joined(hist, of_source, "source").withColumn("large", F.col("size") * LARGE > F.col("source_size"))
    large = hist.where("large and size > 0").groupBy("source").applyInPandas(_round_large, "source string, size long, copies array<long>, large_taken long")
    large = written(large, "large")
    hist = joined(hist, large, "source", "size")
    rest = hist.groupBy("source").agg(F.sum(F.coalesce("large_taken", F.lit(0))).alias("taken"), F.sum(F.when(~F.col("large"), F.col("n") * F.col("size")).otherwise(0)).alias("mass"))
    rest = rest.select("source", "taken", "mass")
    hist = joined(hist, rest, "source")
    hist = hist.withColumn("small_rate", F.when(F.col("mass") > 0, F.least(F.lit(float(MOST)), F.greatest(F.lit(0.0), (F.col("target") - F.col("taken")) / F.col("mass")))).otherwise(0.0))
    before = Window.partitionBy("source", "large").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("larger", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = joined(salted.withColumn("earlier", F.coalesce(F.sum("n").over(within), F.lit(0))).drop("n"), hist.drop("n"), "source", "size")
    base = written(base.select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("salt").alias("__t"), "source_size", "target", "small_rate", "larger", "earlier", "copies"), "ranks").select(
        "__s", "__z", "__t", *(F.col(c).alias(f"__b_{c}") for c in ("source_size", "target", "small_rate", "larger", "earlier", "copies"))
    )
    same = marked["__source"].eqNullSafe(base["__s"]) & (marked["__size"] == base["__z"]) & (marked["__salt"] == base["__t"])
    ranked = marked.join(base, same).withColumn("__k", F.row_number().over(Window.partitionBy("__source", "__size", "__salt").orderBy("doc_id", "__hash")) + F.col("__b_earlier"))
    k = F.col("__k") + F.col("__b_larger")
    by_rank = F.floor(F.col("__b_small_rate") * k + 0.5) - F.floor(F.col("__b_small_rate") * (k - 1) + 0.5)
    copies = F.when(F.col("__b_copies").isNotNull(), F.get("__b_copies", F.col("__k").cast("int") - 1)).otherwise(by_rank).cast("long")
    return ranked.select(*docs.columns, "__size", F.col("__b_source_size").alias("__source_size"), F.col("__b_target").alias("__target"), copies.alias("__copies"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and copies, for each row."""
    out = with_copies(docs.select("doc_id", "text", "source"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"), F.col("__copies").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of docs."""
    return with_copies(docs).withColumn("__i", F.explode(F.when(F.col("__copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("__copies"))))).select(*docs.columns)
