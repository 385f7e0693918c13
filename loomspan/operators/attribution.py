"""Attribution of unresolved names to libraries, and resolution of dependencies, with every outcome kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import library_family

from .graph import cut


def attribute(unresolved: DataFrame, exports: DataFrame, kernels: DataFrame, prefix: str = "") -> DataFrame:
    """unresolved (name) with status and origins: exported by libraries (exports: name, path), else a kernel (name, path), else missing.

    A name is looked up as it is, and where that finds nothing without the prefix. Origins are sorted and distinct.
    """
    by = lambda df, c: df.groupBy("name").agg(F.sort_array(F.collect_set("path")).alias(c))
    e, k = by(exports, "e"), by(kernels, "k")
    bare = F.when(F.col("name").startswith(prefix) & (F.length("name") > len(prefix)), F.substring("name", len(prefix) + 1, 1_000_000)) if prefix else F.lit(None).cast("string")
    out = unresolved.select("name").distinct().withColumn("bare", bare)
    out = out.join(e, "name", "left").join(k, "name", "left")
    out = out.join(e.select(F.col("name").alias("bare"), F.col("e").alias("e2")), "bare", "left").join(k.select(F.col("name").alias("bare"), F.col("k").alias("k2")), "bare", "left")
    lib, ker = F.coalesce("e", "e2"), F.coalesce("k", "k2")
    status = F.when(lib.isNotNull(), "library").when(ker.isNotNull(), "kernel").otherwise("missing")
    return out.select("name", status.alias("status"), F.coalesce(lib, ker, F.array().cast("array<string>")).alias("origins"))


def conflicts(exports: DataFrame) -> DataFrame:
    """Names that more than one library exports; one library naming it twice is no conflict."""
    return exports.groupBy("name").agg(F.sort_array(F.collect_set("path")).alias("paths")).where(F.size("paths") > 1)


def missing_dependencies(deps: DataFrame, provided: DataFrame) -> DataFrame:
    """deps (path, name, kind) whose family nothing provides (name); search paths and own ids are no dependencies."""
    needed = deps.where(~F.col("kind").isin("rpath", "runpath", "dyld", "id")).withColumn("family", library_family(F.col("name")))
    have = provided.select(library_family(F.col("name")).alias("family")).distinct()
    return needed.join(have, "family", "left_anti").select("path", "name", "family")


def resolve_candidates(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (ref, bits) against files (path, file, bits, real): by exact name, else ignoring case, else by family.

    status: found (one real file on the first rung with a hit, or one of the right bits), ambiguous (several), not_found.
    """
    f = files.withColumns({"lname": F.lower("file"), "family": library_family(F.col("file"))})
    r = refs.select("ref", F.col("bits").alias("want")).distinct()
    hits = r.join(f, r["ref"] == f["file"]).select("ref", "want", "real", "bits", F.lit(1).alias("rung"))
    hits = hits.unionByName(r.join(f, F.lower(r["ref"]) == f["lname"]).select("ref", "want", "real", "bits", F.lit(2).alias("rung")))
    hits = hits.unionByName(r.join(f, library_family(r["ref"]) == f["family"]).select("ref", "want", "real", "bits", F.lit(3).alias("rung")))
    first = hits.withColumn("best", F.min("rung").over(Window.partitionBy("ref", "want"))).where("rung = best")
    fits = F.when(F.col("bits") == F.col("want"), F.col("real"))
    n = first.groupBy("ref", "want", "rung").agg(F.countDistinct("real").alias("n"), F.min("real").alias("one"), F.countDistinct(fits).alias("n_fit"), F.min(fits).alias("one_fit"))
    found = F.when(F.col("n") == 1, F.col("one")).when(F.col("n_fit") == 1, F.col("one_fit"))
    status = F.when(F.col("n").isNull(), "not_found").when(found.isNotNull(), "found").otherwise("ambiguous")
    return r.join(n, ["ref", "want"], "left").select("ref", F.col("want").alias("bits"), status.alias("status"), "rung", found.alias("real"))


def dependency_levels(roots: DataFrame, deps: DataFrame, depth: int, max_nodes: int) -> tuple[DataFrame, bool]:
    """path and level of all that roots (path) need over deps (path, needs), each once; and whether a bound cut it short."""
    seen = cut(roots.select("path").distinct().withColumn("level", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        nxt = frontier.join(deps, "path").select(F.col("needs").alias("path")).distinct()
        frontier = cut(nxt.join(seen.select("path"), "path", "left_anti").withColumn("level", F.lit(level)))
        n = frontier.count()
        if not n:
            return seen, False
        if seen.count() + n > max_nodes:
            return seen, True
        seen = cut(seen.unionByName(frontier))
    return seen, not frontier.join(deps, "path").join(seen.select(F.col("path").alias("needs")), "needs", "left_anti").isEmpty()
