"""Census queries over documents, parts, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators import census as C
from loomspan.operators import graph as G

from . import Query, table
from .graphs import _E, edges

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


_add("unmapped_stats", lambda s, d: C.coverage_rates(table(s, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").cast("int").alias("ok"), (F.col("l_returnflag") == "R").cast("int").alias("bad")), "l_orderkey", "ok", "bad"), "with p as (select l_orderkey, sum(cast(l_returnflag <> 'R' as int)) as d, sum(cast(l_returnflag = 'R' as int)) as u from lineitem group by 1), r as (select u, 1 - u / (d + u) as rate from p) select round(avg(rate), 6) as mean_rate, cast(count_if(rate >= 0.9) as bigint) as good, cast(count_if(u = 0) as bigint) as clean, count(*) as files from r")
_add("unmapped_report", lambda s, d: table(s, d, "lineitem").where("l_returnflag = 'R' and l_linestatus <> 'F' or l_returnflag = 'A'").groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(30), "select l_suppkey, count(*) as n from lineitem where l_returnflag = 'R' and l_linestatus <> 'F' or l_returnflag = 'A' group by 1 order by n desc, l_suppkey limit 30")
_FLAGS = [("table", r" \| "), ("shout", "!!"), ("digits", "[0-9]{4}"), ("mail", "@"), ("web", "https?://"), ("mark", "[#$%&*]{3}")]
_add(
    "bucket_census",
    lambda s, d: C.shares(_doc(s, d).select("doc_id", C.flags_label([(n, F.col("text").rlike(r)) for n, r in _FLAGS]).alias("label")), "label", "doc_id", "doc_id"),
    "with l as (select doc_id, concat_ws('+', " + ", ".join(f"case when regexp_matches(text, '{r}') then '{n}' end" for n, r in _FLAGS) + ") as x from documents), m as (select doc_id, case when x = '' then 'plain' else x end as label from l), n as (select label, count(*) as n, min(doc_id) as sample from m group by label) select label, n, sample, round(100 * n / sum(n) over (), 1) as pct from n",
)
_RULES = [("empty", "length(trim(text)) = 0"), ("long", "length(text) > 5000"), ("table", "text like '% | %'"), ("short", "length(text) < 500")]
_add(
    "gap_attribution",
    lambda s, d: C.shares(_doc(s, d).select("doc_id", C.ladder([(n, F.expr(r)) for n, r in _RULES], "other").alias("label")), "label", "doc_id", "doc_id"),
    "with m as (select doc_id, case " + " ".join(f"when {r} then '{n}'" for n, r in _RULES) + " else 'other' end as label from documents), n as (select label, count(*) as n, min(doc_id) as sample from m group by label) select label, n, sample, round(100 * n / sum(n) over (), 1) as pct from n",
)
_add("case_picker", lambda s, d: _doc(s, d).groupBy(C.ladder([("marks", F.col("text").rlike("[#$%&*]{3}")), ("caps", F.col("text").rlike("[A-Z]{6}")), ("secret", F.col("text").rlike("(?i)passw|secret"))], "picked").alias("reason")).agg(F.count("*").alias("n")), "select case when regexp_matches(text, '[#$%&*]{3}') then 'marks' when regexp_matches(text, '[A-Z]{6}') then 'caps' when regexp_matches(text, '(?i)passw|secret') then 'secret' else 'picked' end as reason, count(*) as n from documents group by 1")
_add("runtime_payoff", lambda s, d: C.sole_blockers(table(s, d, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag"), "with k as (select distinct l_orderkey, l_returnflag from lineitem), a as (select l_orderkey, min(l_returnflag) as l_returnflag from k group by 1 having count(*) = 1) select k.l_returnflag, count(*) as any_file, coalesce(max(s.sole), 0) as sole from k left join (select l_returnflag, count(*) as sole from a group by 1) s on s.l_returnflag = k.l_returnflag group by 1")
_add(
    "degradation_ratio",
    lambda s, d: C.marked_soon(table(s, d, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("call"), (F.col("value") > 80).alias("mark")), "user_id", "event_id", "call", "mark"),
    "with h as (select user_id, event_type = 'click' as call, bool_or(value > 80) over (partition by user_id order by event_id rows between current row and 3 following) as hit from events) select user_id, count(*) as calls, cast(count_if(hit) as bigint) as degraded, round(count_if(hit) / count(*), 6) as ratio from h where call group by user_id",
)
_FEATURES = {"pipe": "\\|", "number": "[0-9]+", "upper": "[A-Z]", "the": "the"}
_add("feature_coverage", lambda s, d: C.feature_counts(_doc(s, d), "text", _FEATURES), " union all ".join(f"select '{k}' as feature, cast(count_if(len(regexp_extract_all(text, '{v}')) > 0) as bigint) as texts, cast(sum(len(regexp_extract_all(text, '{v}'))) as bigint) as hits from documents" for k, v in _FEATURES.items()))
_add("census_calibers", lambda s, d: C.calibers(_doc(s, d), "text", "the"), r"with n as (select sum(len(regexp_extract_all(text, 'the'))) as a, sum(len(regexp_extract_all(text, '\bthe\b'))) as w from documents) select cast(a as bigint) as anywhere, cast(w as bigint) as whole, cast(a - w as bigint) as delta from n")
_APIS = [("thread", "(?i)thread"), ("lock", "(?i)lock|mutex"), ("wait", "(?i)wait|join"), ("send", "(?i)send|recv")]
_add(
    "census_concurrency",
    lambda s, d: _doc(s, d).select("lang", F.explode(F.array(*(F.struct(F.lit(n).alias("api"), F.regexp_count("text", F.lit(r)).alias("k")) for n, r in _APIS))).alias("c")).groupBy("lang", F.col("c.api").alias("api")).agg(F.sum("c.k").cast("long").alias("n")),
    "with c as (" + " union all ".join(f"select lang, '{n}' as api, len(regexp_extract_all(text, '{r}')) as k from documents" for n, r in _APIS) + ") select lang, api, cast(sum(k) as bigint) as n from c group by 1, 2",
)
_add("hop_census", lambda s, d: table(s, d, "part").groupBy(F.substring_index("p_brand", "#", 1).alias("prefix"), F.substring(F.substring_index("p_brand", "#", -1), 1, 1).alias("digit")).agg(F.count("*").alias("n")), "select string_split(p_brand, '#')[1] as prefix, substr(string_split(p_brand, '#')[2], 1, 1) as digit, count(*) as n from part group by 1, 2")


def _graph_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).withColumn("kind", F.lit("call"))
    sites = table(spark, sf_dir, "lineitem").groupBy(F.lit("edge").alias("outcome")).agg(F.count("*").alias("n"))
    return C.conservation(e, sites, table(spark, sf_dir, "part").select((F.col("p_partkey") - F.col("p_partkey") % 2).alias("node")), ("edge",))


_add(
    "graph_conservation",
    _graph_checks,
    f"""with {_E}, n as (select p_partkey - p_partkey % 2 as node from part), r as (select 'edges are produced sites' as rule, (select count(*) from lineitem) as expected, (select count(*) from e) as found
    union all select 'edges end at nodes', 0, (select count(*) from (select src as x from e union all select dst from e) where x not in (select node from n))
    union all select 'nodes are unique', 0, (select count(*) from (select node from n group by node having count(*) > 1))) select rule, expected, found, expected = found as ok from r""",
)


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("func"), F.when(F.col("l_linenumber") != 3, F.array(F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"))).alias("shape"))


_ARR = "a as (select l_suppkey as func, case when l_linenumber <> 3 then cast(l_quantity as bigint) * l_linenumber end as n from lineitem)"
_add("mem_budget", lambda s, d: C.static_bytes(_arrays(s, d), "func", "shape").withColumn("over", F.col("bytes") > 300_000), f"with {_ARR} select func, cast(coalesce(sum(n * 8), 0) as bigint) as bytes, cast(count_if(n is null) as bigint) as unknown, coalesce(sum(n * 8), 0) > 300000 as over from a group by func")
_add("mem_offenders", lambda s, d: _arrays(s, d).where("shape is not null").select("func", (F.element_at("shape", 1) * F.element_at("shape", 2) * 8).alias("bytes")).groupBy("func").agg(F.max("bytes").alias("bytes")).orderBy(F.desc("bytes"), "func").limit(5), f"with {_ARR} select func, max(n * 8) as bytes from a where n is not null group by func order by bytes desc, func limit 5")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _arrays(spark, sf_dir).where("shape is not null").withColumn("bytes", F.element_at("shape", 1) * F.element_at("shape", 2) * 8)
    placed = C.first_section(a, F.col("bytes"), [("fast", 200), ("near", 900), ("far", 2500)])
    per = placed.groupBy("section", "func").agg(F.sum("bytes").alias("bytes"))
    return per.groupBy("section").agg(F.max("bytes").alias("peak"), F.max_by("func", F.struct("bytes", -F.col("func"))).alias("worst_func"))


_add("mem_sections", _sections, f"with {_ARR}, s as (select func, n * 8 as bytes, case when n * 8 <= 200 then 'fast' when n * 8 <= 900 then 'near' when n * 8 <= 2500 then 'far' end as section from a where n is not null), p as (select section, func, cast(sum(bytes) as bigint) as bytes from s group by 1, 2) select section, bytes as peak, func as worst_func from p qualify row_number() over (partition by section order by bytes desc, func) = 1")


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order calls those of three times its key; every fiftieth calls back, so that it and what leads there is on a cycle."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 3).alias("up"), F.col("o_custkey").alias("bytes"))
    calls = o.select(F.col("up").alias("src"), F.col("o_orderkey").alias("dst")).unionByName(o.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("src"), F.col("up").alias("dst")))
    return C.call_chain_bytes(o.select(F.col("o_orderkey").alias("node"), "bytes"), calls)


_add(
    "mem_callchain",
    _chain,
    """with recursive o as (select o_orderkey as node, o_orderkey // 3 as up, o_custkey as bytes from orders), e as (select up as src, node as dst from o where up in (select node from o) union all select node, up from o where node % 50 = 0 and up in (select node from o)),
    r(a, b) as (select src, dst from e union select r.a, e.dst from r join e on e.src = r.b), c as (select distinct a from r where a = b), bad as (select a from c union select r.a from r join c on r.b = c.a),
    w(root, node) as (select node, node from o where node not in (select a from bad) union all select w.root, e.dst from w join e on e.src = w.node)
    select root as node, cast(sum(o.bytes) as bigint) as total from w join o on o.node = w.node group by root union all select a, null from bad""",
)
_add(
    "scenario_coverage",
    lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("ops")).groupBy(C.ladder([("matmul", F.array_contains("ops", 7)), ("reduce", F.array_contains("ops", 6)), ("index", F.array_contains("ops", 5)), ("concat", F.array_contains("ops", 4))], "other").alias("label")).agg(F.count("*").alias("n")),
    "with o as (select l_orderkey, list_distinct(list(l_linenumber)) as ops from lineitem group by 1) select case when list_contains(ops, 7) then 'matmul' when list_contains(ops, 6) then 'reduce' when list_contains(ops, 5) then 'index' when list_contains(ops, 4) then 'concat' else 'other' end as label, count(*) as n from o group by 1",
)
_add(
    "signature_pairs",
    lambda s, d: C.signature_pairs(table(s, d, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("args"), F.lit(1).alias("rets")), table(s, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, "Q").otherwise(F.col("o_orderstatus")).alias("args"), (F.col("o_orderkey") % 2 + 1).alias("rets"))),
    "select o_orderkey as name, case when o_orderkey % 5 = 0 then 'only_left' when o_orderkey % 4 = 0 then 'only_right' when o_orderkey % 3 = 0 or o_orderkey % 2 = 1 then 'mismatched' else 'matched' end as status, case when o_orderkey % 5 = 0 or o_orderkey % 4 = 0 then '' else concat_ws(',', case when o_orderkey % 3 = 0 then 'args' end, case when o_orderkey % 2 = 1 then 'rets' end) end as reasons from orders where not (o_orderkey % 5 = 0 and o_orderkey % 4 = 0)",
)
_add(
    "value_parity",
    lambda s, d: C.parity(table(s, d, "orders").where("o_orderkey % 9 <> 0"), table(s, d, "orders").where("o_orderkey % 8 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") * (1 + 1e-12)).when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))), "o_orderkey", "o_totalprice").where("status not in ('identical', 'close')").groupBy("status").agg(F.count("*").alias("n")),
    "select case when o_orderkey % 8 = 0 then 'only_left' when o_orderkey % 9 = 0 then 'only_right' else 'mismatch' end as status, count(*) as n from orders where not (o_orderkey % 8 = 0 and o_orderkey % 9 = 0) and (o_orderkey % 8 = 0 or o_orderkey % 9 = 0 or (o_orderkey % 2 = 1 and o_orderkey % 3 = 0)) group by 1",
)
_add(
    "trace_chain",
    lambda s, d: C.broken_links(table(s, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 7).alias("taken"), (F.col("o_orderkey") % 5).alias("made")), "o_custkey", "o_orderkey", "taken", "made"),
    "with s as (select o_custkey, o_orderkey, o_orderkey % 7 as taken, o_orderkey % 5 as made, min(o_orderkey) over (partition by o_custkey) as first from orders) select o_custkey, o_orderkey, taken from s where o_orderkey > first and not exists (select 1 from s p where p.o_custkey = s.o_custkey and p.made = s.taken and p.o_orderkey < s.o_orderkey)",
)
_add("structure_measures", lambda s, d: _doc(s, d).groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.size(F.split("text", "\n")) > 20).alias("long_docs"), F.max(F.size(F.split("text", "\n"))).cast("long").alias("most_lines")), "select lang, count(*) as docs, cast(count_if(len(string_split(text, chr(10))) > 20) as bigint) as long_docs, max(len(string_split(text, chr(10)))) as most_lines from documents group by lang")
_add("isa_plan", lambda s, d: _arrays(s, d).select("func", F.array_join(F.filter(F.array(F.when(F.col("shape").isNull(), "unknown"), F.when(F.element_at("shape", 1) < 8, "short"), F.when(F.element_at("shape", 1) % 4 != 0, "multiple")), lambda r: r.isNotNull()), ",").alias("why")).groupBy("why").agg(F.count("*").alias("n")), "with a as (select concat_ws(',', case when l_linenumber = 3 then 'unknown' end, case when l_linenumber <> 3 and l_quantity < 8 then 'short' end, case when l_linenumber <> 3 and cast(l_quantity as bigint) % 4 <> 0 then 'multiple' end) as why from lineitem) select why, count(*) as n from a group by why")
_add("task_kpi", lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("cases"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("pass_rate")), "select o_orderpriority, count(*) as cases, round(avg(cast(o_orderstatus = 'F' as int)), 6) as pass_rate from orders group by 1")
_add("taint_levels", lambda s, d: G.distances(edges(s, d), table(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")), 5, reverse=True)[0], f"with recursive {_E}, r(node, level) as (select p_partkey, 0 from part where p_size = 1 union select e.src, level + 1 from r join e on e.dst = r.node where level < 5) select node, cast(min(level) as int) as level from r group by node")
_add("clone_roi", lambda s, d: table(s, d, "part").groupBy("p_name").agg(F.count("*").alias("k"), F.min("p_size").cast("long").alias("lines"), F.max(F.col("p_size") % 5 + 1).cast("long").alias("cx")).where("k > 1").select("p_name", F.round(F.col("lines") * (F.col("k") - 1) / F.col("cx") * F.when(F.col("cx") == 1, 0.75).otherwise(1.0), 6).alias("roi")), "with g as (select p_name, count(*) as k, cast(min(p_size) as bigint) as lines, cast(max(p_size % 5 + 1) as bigint) as cx from part group by 1 having count(*) > 1) select p_name, round(lines * (k - 1) / cx * case when cx = 1 then 0.75 else 1.0 end, 6) as roi from g")
