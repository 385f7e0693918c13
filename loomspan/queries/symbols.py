"""Symbol store queries: brands are files, parts symbols, line items references and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import symbols as S

from . import Query, table
from .graphs import _D, _E, edges

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand").distinct().select(F.substring_index("p_brand", "#", -1).cast("long").alias("file_id"), F.concat(F.lit("src/"), "p_brand").alias("path"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "class").otherwise("function")
    return p.select(F.col("p_partkey").alias("symbol_id"), F.substring_index("p_brand", "#", -1).cast("long").alias("file_id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_type", "p_name").alias("dotted_name"), kind.alias("kind"), F.col("p_size").cast("long").alias("line"))


_B = "f as (select distinct cast(string_split(p_brand, '#')[-1] as bigint) as file_id, 'src/' || p_brand as path from part), s as (select p_partkey as symbol_id, cast(string_split(p_brand, '#')[-1] as bigint) as file_id, p_name as name, p_type || '.' || p_name as dotted_name, case when p_size % 3 = 0 then 'class' else 'function' end as kind, cast(p_size as bigint) as line from part)"


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("_", "p_name", "p_size").alias("p_name")), "l_partkey")
    return named.select((F.col("l_suppkey") % 25 + 11).alias("file_id"), F.when(F.col("l_orderkey") % 9 == 0, "none").otherwise(F.col("p_name")).alias("name"), F.col("l_orderkey").alias("line"), F.col("l_linenumber").cast("long").alias("col"))


def store_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    kind = F.when(F.col("dst") % 7 == 0, "external").when(F.col("dst") % 5 == 0, "builtin").when(F.col("dst") % 11 == 0, "dynamic").otherwise("call")
    return e.select(F.col("src").alias("src_symbol_id"), F.when(kind == "external", None).otherwise(F.col("dst")).alias("dst_symbol_id"), F.concat(F.lit("fn"), F.col("dst") % 50).alias("name"), kind.alias("kind"))


_SE = f"{_E}, x as (select src as src_symbol_id, case when dst % 7 <> 0 then dst end as dst_symbol_id, 'fn' || (dst % 50) as name, case when dst % 7 = 0 then 'external' when dst % 5 = 0 then 'builtin' when dst % 11 = 0 then 'dynamic' else 'call' end as kind from e)"
_add("sym_query", lambda s, d: S.query_symbols(symbols(s, d), files(s, d), "RE", "function", 50), f"with {_B} select symbol_id, name, kind, path, line from s join f on f.file_id = s.file_id where kind = 'function' and (contains(lower(name), 're') or contains(lower(dotted_name), 're')) order by path, line, symbol_id limit 50")
_add("sym_row", lambda s, d: S.symbol_row(symbols(s, d), files(s, d), "a"), f"with {_B} select symbol_id, name, path, line from s join f on f.file_id = s.file_id where contains(lower(name), 'a') order by case when name = 'a' then 0 else 1 end, path, line, symbol_id limit 1")
_add(
    "sym_refs",
    lambda s, d: S.query_refs(refs(s, d), symbols(s, d).withColumn("name", F.concat_ws("_", "name", "line")), files(s, d)),
    f"""with {_B}, u as (select symbol_id, file_id, name || '_' || line as name from s), r as (select l_suppkey % 25 + 11 as file_id, case when l_orderkey % 9 = 0 then 'none' else p_name || '_' || p_size end as name, l_orderkey as line, cast(l_linenumber as bigint) as col from lineitem join part on p_partkey = l_partkey),
    l as (select file_id, name, min(symbol_id) as l, count(*) as ln from u group by 1, 2), g as (select name, min(symbol_id) as g, count(*) as gn from u group by 1)
    select path, r.line, col, r.name, coalesce(l, g) as symbol_id, case when coalesce(ln, gn) is null then null when coalesce(ln, gn) > 1 then 0.8::double else 1.0::double end as confidence from r left join l on l.file_id = r.file_id and l.name = r.name left join g on g.name = r.name join f on f.file_id = r.file_id""",
)
_add("sym_edges_left", lambda s, d: S.query_edges(store_edges(s, d), symbols(s, d), files(s, d)), f"with {_B}, {_SE} select src_symbol_id, dst_symbol_id, a.name as src_name, b.name as dst_name, x.kind, path from x join s a on a.symbol_id = src_symbol_id left join s b on b.symbol_id = dst_symbol_id join f on f.file_id = a.file_id")
_add("sym_confidence", lambda s, d: S.confidences(store_edges(s, d), symbols(s, d).select(F.concat(F.lit("fn"), F.col("symbol_id") % 20).alias("name"))).groupBy("kind", "confidence").agg(F.count("*").alias("n")), f"with {_SE} select kind, case when kind = 'external' and cast(substr(name, 3) as int) < 20 then 0.55::double when kind = 'external' then 0.35::double when kind = 'builtin' then 0.9::double when kind = 'dynamic' then 0.15::double else 1.0::double end as confidence, count(*) as n from x group by 1, 2")
_add("sym_context", lambda s, d: S.context(store_edges(s, d), 7), f"with {_SE} select distinct * from (select 'calls' as relation, dst_symbol_id as symbol_id from x where src_symbol_id = 7 union all select 'callers', src_symbol_id from x where dst_symbol_id = 7) where symbol_id is not null")
_add("sym_outline", lambda s, d: S.outline(symbols(s, d), 11), f"with {_B} select symbol_id, name, kind, line from s where file_id = 11")
_add("sym_workspace", lambda s, d: symbols(s, d).where(S.contains("name", "b")).groupBy("kind").agg(F.count("*").alias("n"), F.min("name").alias("first_name")), f"with {_B} select kind, count(*) as n, min(name) as first_name from s where contains(lower(name), 'b') group by kind")
_add("sym_status", lambda s, d: symbols(s, d).groupBy("file_id").agg(F.count("*").alias("symbols"), F.count_if(F.col("kind") == "class").alias("classes"), F.max("line").alias("last_line")), f"with {_B} select file_id, count(*) as symbols, cast(count_if(kind = 'class') as bigint) as classes, max(line) as last_line from s group by file_id")


def _prints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 8 <> 0").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("mtime_ns"), F.lit(1).alias("size"), F.col("o_orderstatus").alias("sha256"))
    new = o.where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") + F.col("o_orderkey") % 2).alias("mtime_ns"), F.lit(1).alias("size"), F.when(F.col("o_orderkey") % 3 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("sha256"))
    return old, new


_add("sync_plan", lambda s, d: S.plan_sync(*_prints(s, d)).groupBy("action").agg(F.count("*").alias("n")), "select case when o_orderkey % 8 = 0 then 'added' when o_orderkey % 9 = 0 then 'removed' when o_orderkey % 2 = 0 or o_orderkey % 3 <> 0 then 'unchanged' else 'changed' end as action, count(*) as n from orders where not (o_orderkey % 8 = 0 and o_orderkey % 9 = 0) group by 1")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.operators.graph import degrees

    d = degrees(edges(spark, sf_dir))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 12).cast("long").alias("complexity"), (F.col("p_partkey") % 5).alias("unresolved"))
    return p.join(d, "node", "left").fillna(0, ["fan_in", "fan_out"]).select("node", "complexity", "unresolved", F.col("fan_in").alias("callers"), F.col("fan_out").alias("callees"))


_MET = f"{_E}, {_D}, m as (select p_partkey as node, cast(p_size % 12 as bigint) as complexity, p_partkey % 5 as unresolved, coalesce(fan_in, 0) as callers, coalesce(fan_out, 0) as callees from part left join d on d.node = p_partkey)"
_add(
    "sym_role_risk",
    lambda s, d: S.role_and_risk(_metrics(s, d)).select("node", "role", "risk"),
    f"with {_MET} select node, case when callers = 0 and callees > 0 then 'entry' when callers > 0 and callees = 0 then 'leaf' when callers >= 5 then 'shared' when callers = 0 and callees = 0 then 'isolated' else 'inner' end as role, case when callers >= 5 and complexity >= 5 then 'high' when complexity >= 8 or unresolved >= 3 or callers >= 5 then 'medium' else 'low' end as risk from m",
)
_add(
    "sym_doc_priority",
    lambda s, d: S.doc_priority(_metrics(s, d).select("node", "complexity", F.col("callers").alias("fan_in"), (F.col("node") % 2 == 0).alias("has_desc"), (F.col("node") % 3).alias("inputs_missing"), (F.col("node") % 4).alias("outputs_missing"), (F.col("node") % 5 == 0).alias("has_author"), (F.col("node") % 7 == 0).alias("has_version"), (F.col("node") % 6 == 0).alias("tainted"))).select("node", F.col("doc_score").cast("long").alias("doc_score"), "priority", "joint"),
    f"""with {_MET}, q as (select *, greatest(0, 100 - case when node % 2 = 0 then 0 else 30 end - 10 * (node % 3) - 10 * (node % 4) - case when node % 5 = 0 then 0 else 10 end - case when node % 7 = 0 then 0 else 10 end) as doc_score from m),
    p as (select *, case when complexity >= 8 and callers >= 2 and doc_score < 70 then 'high' when complexity >= 5 and callers > 0 and doc_score < 85 then 'medium' else 'low' end as priority from q)
    select node, cast(doc_score as bigint) as doc_score, priority, case when node % 6 <> 0 then priority when priority = 'high' then 'critical' when priority = 'medium' then 'high' else 'medium' end as joint from p""",
)
_add(
    "entity_contract",
    lambda s, d: S.entity_violations(table(s, d, "part").select(F.when(F.col("p_size") % 10 != 0, F.when(F.col("p_size") % 7 == 0, "blob").otherwise("class")).alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.array(F.struct(F.when(F.col("p_partkey") % 13 != 0, "m").alias("name"))).alias("members")), ("class", "enum")).groupBy("violation").agg(F.count("*").alias("n")),
    "select 'missing kind' as violation, count(*) as n from part where p_size % 10 = 0 union all select 'unknown kind', count(*) from part where p_size % 10 <> 0 and p_size % 7 = 0 union all select 'member without a name', count(*) from part where p_partkey % 13 = 0",
)
_add(
    "sym_enclosing",
    lambda s, d: S.enclosing(table(s, d, "lineitem").select((F.col("l_suppkey") % 25 + 11).alias("file_id"), F.col("l_quantity").cast("long").alias("line")), symbols(s, d)),
    f"with {_B}, p as (select l_suppkey % 25 + 11 as file_id, cast(l_quantity as bigint) as line from lineitem), t as (select file_id, line, max(symbol_id) as symbol_id from s group by 1, 2) select p.file_id, p.line, t.symbol_id from p asof left join t on p.file_id = t.file_id and p.line >= t.line",
)
_add(
    "sym_field_access",
    lambda s, d: S.field_access(table(s, d, "lineitem").select(F.col("l_suppkey").alias("base"), F.col("l_linenumber").cast("string").alias("field"), F.when(F.col("l_returnflag") == "R", "w").otherwise("r").alias("mode"))).select("base", F.array_join("reads", ",").alias("reads"), F.array_join("writes", ",").alias("writes")),
    "with a as (select distinct l_suppkey as base, cast(l_linenumber as varchar) as field, case when l_returnflag = 'R' then 'w' else 'r' end as mode from lineitem) select base, coalesce(string_agg(field, ',' order by field) filter (mode = 'r'), '') as reads, coalesce(string_agg(field, ',' order by field) filter (mode = 'w'), '') as writes from a group by base",
)
_add(
    "sym_bridge",
    lambda s, d: S.bridge(table(s, d, "orders").select(F.concat(F.lit("f"), F.col("o_custkey")).alias("name")), table(s, d, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("f"), F.col("c_custkey")).alias("name"), F.col("c_mktsegment").alias("file")), table(s, d, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey")).alias("name"), F.col("s_name").alias("path"))),
    "with n as (select 'f' || o_custkey as name, count(*) as n from orders group by 1), c as (select 'f' || c_custkey as name, min(c_mktsegment) as c from customer where c_acctbal > 5000 group by 1), b as (select 'f' || s_suppkey as name, min(s_name) as \"binary\" from supplier group by 1) select n.name, n, c, case when c is null then 'unknown' else 'found' end as c_status, \"binary\", case when \"binary\" is null then 'unknown' else 'found' end as binary_status from n left join c on c.name = n.name left join b on b.name = n.name",
)
