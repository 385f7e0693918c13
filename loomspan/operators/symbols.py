"""A symbol store as tables: files, symbols, refs and edges, and the lookups over them.

files (file_id, path), symbols (symbol_id, file_id, name, dotted_name, kind, line), refs (file_id, name, line, col),
edges (src_symbol_id, dst_symbol_id or null, name, kind, confidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Confidence of an edge by its kind; an external one whose name is defined somewhere is surer.
CONFIDENCE = {"call": 1.0, "builtin": 0.9, "external": 0.35, "dynamic": 0.15, "indirect": 0.25}
EXTERNAL_KNOWN = 0.55


def contains(column: str, part: str) -> Column:
    """Substring without regard to case; no character is a wildcard."""
    return F.lower(F.col(column)).contains(part.lower())


def query_symbols(symbols: DataFrame, files: DataFrame, part: str, kind: str | None = None, limit: int = 100) -> DataFrame:
    hit = symbols.where(contains("name", part) | contains("dotted_name", part))
    if kind is not None:
        hit = hit.where(F.col("kind") == kind)
    return hit.join(files, "file_id").select("symbol_id", "name", "kind", "path", "line").orderBy("path", "line", "symbol_id").limit(limit)


def symbol_row(symbols: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """The best single symbol: an exact name first, then path and line."""
    hit = symbols.where(contains("name", name)).join(files, "file_id")
    return hit.orderBy(F.when(F.col("name") == name, 0).otherwise(1), "path", "line", "symbol_id").limit(1).select("symbol_id", "name", "path", "line")


def query_refs(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """refs with their symbol: one of the own file first, else any; the first by id; surer if there is just one."""
    local = symbols.groupBy("file_id", "name").agg(F.min("symbol_id").alias("l"), F.count("*").alias("ln"))
    everywhere = symbols.groupBy("name").agg(F.min("symbol_id").alias("g"), F.count("*").alias("gn"))
    out = refs.join(local, ["file_id", "name"], "left").join(everywhere, "name", "left").join(files, "file_id")
    n = F.coalesce("ln", "gn")
    return out.select("path", "line", "col", "name", F.coalesce("l", "g").alias("symbol_id"), F.when(n.isNull(), F.lit(None).cast("double")).when(n > 1, 0.8).otherwise(1.0).alias("confidence"))


def query_edges(edges: DataFrame, symbols: DataFrame, files: DataFrame, kind: str | None = None) -> DataFrame:
    """Edges with the caller's name and file, and the callee's name or null where it is outside."""
    if kind is not None:
        edges = edges.where(F.col("kind") == kind)
    src = symbols.select(F.col("symbol_id").alias("src_symbol_id"), F.col("name").alias("src_name"), "file_id")
    dst = symbols.select(F.col("symbol_id").alias("dst_symbol_id"), F.col("name").alias("dst_name"))
    return edges.join(src, "src_symbol_id").join(dst, "dst_symbol_id", "left").join(files, "file_id").select("src_symbol_id", "dst_symbol_id", "src_name", "dst_name", "kind", "path")


def confidences(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each edge's confidence by its own kind and name."""
    known = symbols.select("name").distinct().withColumn("known", F.lit(True))
    table = F.create_map(*(x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))))
    sure = F.when((F.col("kind") == "external") & F.col("known"), EXTERNAL_KNOWN).otherwise(F.try_element_at(table, F.col("kind")))
    return edges.join(known, "name", "left").select("src_symbol_id", "name", "kind", sure.alias("confidence"))


def context(edges: DataFrame, symbol_id: int) -> DataFrame:
    """Neighbours of a symbol: relation (calls or callers) and symbol_id."""
    out = edges.where(F.col("src_symbol_id") == symbol_id).select(F.lit("calls").alias("relation"), F.col("dst_symbol_id").alias("symbol_id"))
    back = edges.where(F.col("dst_symbol_id") == symbol_id).select(F.lit("callers").alias("relation"), F.col("src_symbol_id").alias("symbol_id"))
    return out.unionByName(back).where("symbol_id is not null").distinct()


def outline(symbols: DataFrame, file_id: int) -> DataFrame:
    return symbols.where(F.col("file_id") == file_id).select("symbol_id", "name", "kind", "line").orderBy("line", "symbol_id")


def plan_sync(old: DataFrame, scanned: DataFrame) -> DataFrame:
    """path and action from fingerprints (path, mtime_ns, size, sha256): equal time and size need no hash."""
    j = old.alias("o").join(scanned.alias("s"), "path", "full_outer")
    quick = (F.col("o.mtime_ns") == F.col("s.mtime_ns")) & (F.col("o.size") == F.col("s.size"))
    action = F.when(F.col("o.sha256").isNull(), "added").when(F.col("s.sha256").isNull(), "removed").when(quick | (F.col("o.sha256") == F.col("s.sha256")), "unchanged").otherwise("changed")
    return j.select("path", action.alias("action"))


def role_and_risk(functions: DataFrame) -> DataFrame:
    """functions (callers, callees, complexity, unresolved) with role and risk, by the first rule that fits."""
    c, d, x, u = (F.col(k) for k in ("callers", "callees", "complexity", "unresolved"))
    role = F.when((c == 0) & (d > 0), "entry").when((c > 0) & (d == 0), "leaf").when(c >= 5, "shared").when((c == 0) & (d == 0), "isolated").otherwise("inner")
    risk = F.when((c >= 5) & (x >= 5), "high").when(x >= 8, "medium").when(u >= 3, "medium").when(c >= 5, "medium").otherwise("low")
    return functions.withColumns({"role": role, "risk": risk})


def doc_priority(functions: DataFrame) -> DataFrame:
    """functions (has_desc, inputs_missing, outputs_missing, has_author, has_version, complexity, fan_in, tainted) with doc_score, priority, joint."""
    score = F.greatest(F.lit(0), 100 - F.when(F.col("has_desc"), 0).otherwise(30) - 10 * F.col("inputs_missing") - 10 * F.col("outputs_missing") - F.when(F.col("has_author"), 0).otherwise(10) - F.when(F.col("has_version"), 0).otherwise(10))
    out = functions.withColumn("doc_score", score)
    x, f, s = F.col("complexity"), F.col("fan_in"), F.col("doc_score")
    priority = F.when((x >= 8) & (f >= 2) & (s < 70), "high").when((x >= 5) & (f > 0) & (s < 85), "medium").otherwise("low")
    out = out.withColumn("priority", priority)
    up = F.create_map(*(F.lit(v) for v in ("high", "critical", "medium", "high", "low", "medium")))
    return out.withColumn("joint", F.when(F.col("tainted"), F.element_at(up, F.col("priority"))).otherwise(F.col("priority")))


def entity_violations(entities: DataFrame, kinds: tuple[str, ...], required: tuple[str, ...] = ("kind", "name", "file", "line")) -> DataFrame:
    """A row for each broken rule: missing fields, unknown kinds, members without a name."""
    e = entities.withColumn("id", F.xxhash64(*required))
    rules = [F.when(F.col(r).isNull(), F.lit(f"missing {r}")) for r in required]
    rules.append(F.when(~F.col("kind").isin(*kinds), F.lit("unknown kind")))
    rules.append(F.when(F.exists("members", lambda m: m["name"].isNull()), F.lit("member without a name")))
    return e.select("name", "file", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("violation"))


def top_of_each(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def enclosing(positions: DataFrame, symbols: DataFrame) -> DataFrame:
    """positions (file_id, line) with the last symbol that begins at or before each: symbol_id, or null before the first.

    Both go through one sort per file; no range join. Of symbols on one line the largest id counts.
    """
    a = symbols.select("file_id", "line", F.lit(0).alias("side"), "symbol_id")
    b = positions.select("file_id", "line", F.lit(1).alias("side"), F.lit(None).cast("long").alias("symbol_id"))
    w = Window.partitionBy("file_id").orderBy("line", "side", "symbol_id").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("symbol_id", F.last("symbol_id", ignorenulls=True).over(w)).where("side = 1").drop("side")


def field_access(accesses: DataFrame) -> DataFrame:
    """base with its read and written fields (each sorted, once) from accesses (base, field, mode: r or w)."""
    of = lambda m: F.sort_array(F.collect_set(F.when(F.col("mode") == m, F.col("field"))))
    return accesses.groupBy("base").agg(of("r").alias("reads"), of("w").alias("writes"))


def bridge(calls: DataFrame, c_index: DataFrame | None, binary_index: DataFrame | None) -> DataFrame:
    """External names called (name) with the C file (name, file) and the binary (name, path) that define them, and status.

    An index that isn't there is "disabled", one without rows "no_sources"; only then "found" and "unknown" mean something.
    """
    names = calls.groupBy("name").agg(F.count("*").alias("n"))
    for index, column, out in ((c_index, "file", "c"), (binary_index, "path", "binary")):
        if index is None or index.isEmpty():
            status = "disabled" if index is None else "no_sources"
            names = names.withColumns({out: F.lit(None).cast("string"), f"{out}_status": F.lit(status)})
        else:
            first = index.groupBy("name").agg(F.min(column).alias(out))
            names = names.join(first, "name", "left").withColumn(f"{out}_status", F.when(F.col(out).isNull(), "unknown").otherwise("found"))
    return names
