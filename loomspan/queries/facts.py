"""Facts, diffs and gates over events, orders, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators import facts as A

from . import Query, table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as alerts: rule, rel (user), line, level by value."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("value") > 75, "error").when(F.col("value") > 40, "warning").otherwise("note")
    return e.select("event_id", F.col("event_type").alias("rule"), F.when(F.col("user_id") % 9 != 0, F.concat(F.lit("u"), F.col("user_id") % 50)).alias("rel"), (F.col("event_id") % 40).alias("line"), level.alias("level"))


_A = "a as (select event_id, event_type as rule, case when user_id % 9 <> 0 then 'u' || (user_id % 50) end as rel, event_id % 40 as line, case when value > 75 then 'error' when value > 40 then 'warning' else 'note' end as level from events)"


def all_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, o = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    return A.union(
        A.facts("file", part.select("p_brand").distinct(), F.col("p_brand"), F.lit(None), F.col("p_brand")),
        A.facts("function", part, F.col("p_brand"), F.col("p_size"), F.col("p_name"), complexity=F.col("p_size")),
        A.facts("call", o, F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderpriority")), F.lit(1), F.col("o_custkey"), status=F.col("o_orderstatus")),
        A.facts("issue", alerts(spark, sf_dir), F.col("rel"), F.col("line"), F.col("rule"), level=F.col("level")),
    )


_F = f"""{_A}, f as (select 'file' as kind, p_brand as file, p_brand as subject from (select distinct p_brand from part) union all select 'function', p_brand, p_name from part
    union all select 'call', case when o_orderkey % 17 <> 0 then o_orderpriority end, cast(o_custkey as varchar) from orders union all select 'issue', rel, rule from a)"""
_add("facts_union", lambda s, d: all_facts(s, d).groupBy("kind", "file").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects")), f"with {_F} select kind, file, count(*) as n, count(distinct subject) as subjects from f group by 1, 2")
_add("facts_replay", lambda s, d: A.replay(all_facts(s, d)), f"with {_F} select k.kind, count(f.kind) as n, count(distinct f.file) as files from (values ('file'), ('function'), ('call'), ('unresolved'), ('issue')) k(kind) left join f on f.kind = k.kind group by k.kind")
_add("facts_positions", lambda s, d: A.without_position(all_facts(s, d)).groupBy("kind").agg(F.count("*").alias("n")), f"with {_F} select kind, count(*) as n from f where kind <> 'file' and coalesce(file, '') = '' group by kind")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")))


_V = "b as (select * from orders where o_orderkey % 5 <> 0), c as (select o_orderkey, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_totalprice from orders where o_orderkey % 7 <> 0)"
_add(
    "snapshot_diff",
    lambda s, d: A.diff(*_versions(s, d), ["o_orderkey"], ["o_orderstatus", "o_totalprice"]),
    f"with {_V} select coalesce(b.o_orderkey, c.o_orderkey) as o_orderkey, case when b.o_orderkey is null then 'added' when c.o_orderkey is null then 'removed' when b.o_orderstatus is not distinct from c.o_orderstatus and b.o_totalprice is not distinct from c.o_totalprice then 'unchanged' else 'changed' end as status from b full join c on b.o_orderkey = c.o_orderkey",
)


def _suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(spark, sf_dir).where("event_id % 13 = 0").select("rule", "rel", "line")


_add("alert_suppress", lambda s, d: A.suppressed(alerts(s, d), _suppressions(s, d), ["rule", "rel", "line"]).select("event_id", "rule", "rel", "line"), f"with {_A} select event_id, rule, rel, line from a where not exists (select 1 from a s where s.event_id % 13 = 0 and s.rule = a.rule and s.rel is not distinct from a.rel and s.line = a.line)")
_add("alert_tally", lambda s, d: alerts(s, d).groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "error").alias("errors")), f"with {_A} select rule, count(*) as n, cast(count_if(level = 'error') as bigint) as errors from a group by rule")
_add(
    "alert_groups",
    lambda s, d: alerts(s, d).withColumn("r", F.row_number().over(Window.partitionBy("rule").orderBy(F.when(F.col("level") == "error", 0).otherwise(1), "event_id"))).withColumn("total", F.count("*").over(Window.partitionBy("rule"))).where("r <= 12").select("rule", "event_id", "level", "total"),
    f"with {_A} select rule, event_id, level, count(*) over (partition by rule) as total from a qualify row_number() over (partition by rule order by case when level = 'error' then 0 else 1 end, event_id) <= 12",
)
_add("gate_by_rule", lambda s, d: A.gate(alerts(s, d), {"click": 10, "view": 1_000_000, "purchase": 100, "never": 0}), f"with {_A} select l.rule, count(a.rule) as n, l.most, count(a.rule) > l.most as over from (values ('click', 10::bigint), ('view', 1000000), ('purchase', 100), ('never', 0)) l(rule, most) left join a on a.rule = l.rule group by l.rule, l.most")
_add(
    "sarif_new_fixed",
    lambda s, d: A.new_and_fixed(alerts(s, d).where("event_id % 4 < 2"), alerts(s, d).where("event_id % 4 between 1 and 2"), ["rel", "line", "rule"]),
    f"with {_A}, b as (select distinct rel, line, rule from a where event_id % 4 < 2), c as (select distinct rel, line, rule from a where event_id % 4 between 1 and 2) select *, 'new' as state from (select * from c except select * from b) union all select *, 'fixed' from (select * from b except select * from c)",
)
_add("learned_fix_latest", lambda s, d: A.latest(table(s, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", 50).select("user_id", "event_id", "event_type"), "with l as (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) select user_id, event_id, event_type from l order by ts desc, event_id desc limit 50")
_add("rule_signature", lambda s, d: A.rule_signature(alerts(s, d).where("rel is not null"), "rel", "rule"), f"with {_A}, n as (select rel, rule, count(*) as n from a where rel is not null group by 1, 2) select rel, '{{' || string_agg('\"' || rule || '\":' || n, ',' order by rule) || '}}' as signature from n group by rel")


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "pages")
    digest = F.sha2(F.col("html"), 256)
    old = p.where("page_id % 11 <> 0").select("url", digest.alias("sha"))
    new = p.where("page_id % 13 <> 0").select("url", F.sha2(F.when(F.col("page_id") % 6 == 0, F.concat("html", F.lit("<!-- -->"))).otherwise(F.col("html")), 256).alias("sha"))
    return old.groupBy("url").agg(F.max("sha").alias("sha")), new.groupBy("url").agg(F.max("sha").alias("sha"))


_add(
    "fp_diff",
    lambda s, d: A.diff(*_pages(s, d), ["url"], ["sha"]).groupBy("status").agg(F.count("*").alias("n")),
    """with b as (select url, max(sha256(html)) as sha from pages where page_id % 11 <> 0 group by url), c as (select url, max(sha256(case when page_id % 6 = 0 then html || '<!-- -->' else html end)) as sha from pages where page_id % 13 <> 0 group by url)
    select case when b.url is null then 'added' when c.url is null then 'removed' when b.sha = c.sha then 'unchanged' else 'changed' end as status, count(*) as n from b full join c on b.url = c.url group by 1""",
)
_add("tree_diff", lambda s, d: A.diff(*_pages(s, d), ["url"], ["sha"]).where("status <> 'unchanged'"), "with b as (select url, max(sha256(html)) as sha from pages where page_id % 11 <> 0 group by url), c as (select url, max(sha256(case when page_id % 6 = 0 then html || '<!-- -->' else html end)) as sha from pages where page_id % 13 <> 0 group by url) select coalesce(b.url, c.url) as url, case when b.url is null then 'added' when c.url is null then 'removed' else 'changed' end as status from b full join c on b.url = c.url where b.sha is distinct from c.sha")
_add("snapshot_fingerprint", lambda s, d: table(s, d, "orders").select("o_orderkey", A.fingerprint(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("fp")), "select o_orderkey, sha256(length(cast(o_custkey as varchar)) || ':' || o_custkey || '|' || length(o_orderstatus) || ':' || o_orderstatus || '|' || length(o_orderpriority) || ':' || o_orderpriority) as fp from orders")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("elapsed_ms"), (F.col("event_id") % 10 == 0).alias("rolled_back"), "event_id")


_T = "t as (select event_type as kind, cast(floor(value) as bigint) as elapsed_ms, event_id % 10 = 0 as rolled_back from events)"
_S = f"{_T}, g as (select kind, count(*) as n, cast(sum(cast(rolled_back as int)) as bigint) as rollbacks, cast(trunc(avg(elapsed_ms) filter (elapsed_ms > 0)) as bigint) as avg_ms, list_sort(list(elapsed_ms) filter (elapsed_ms > 0)) as l from t group by kind), s as (select kind, n, rollbacks, avg_ms, l[len(l) // 2 + 1] as p50_ms, l[len(l)] as max_ms from g)"
_add("task_stats", lambda s, d: A.task_stats(tasks(s, d)), f"with {_S} select * from s")
_add("task_baseline_ratio", lambda s, d: A.against_baseline(A.task_stats(tasks(s, d)), s.sql("select * from values ('click', 1L), ('view', 1000000L), ('purchase', 2L) t(kind, base_ms)"), "kind", 1.5).select("kind", "p50_ms", "base_ms", "ratio"), f"with {_S} select s.kind, p50_ms, base_ms, round(p50_ms / base_ms, 6) as ratio from s join (values ('click', 1::bigint), ('view', 1000000), ('purchase', 2)) b(kind, base_ms) on b.kind = s.kind where p50_ms >= 1.5 * base_ms")
_add("rollback_reasons", lambda s, d: table(s, d, "events").where("event_id % 10 = 0").select(F.explode(F.split(F.concat_ws("、", "event_type", F.when(F.col("value") > 50, "slow"), F.lit("manual")), "、")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")), "with r as (select unnest(string_split(concat_ws('、', event_type, case when value > 50 then 'slow' end, 'manual'), '、')) as reason from events where event_id % 10 = 0) select reason, count(*) as n from r group by reason")
_add("json_diff", lambda s, d: A.diff(A.json_paths(table(s, d, "events").where("event_id % 3 <> 0"), "event_id", "props"), A.json_paths(table(s, d, "events").where("event_id % 5 <> 0"), "event_id", "props"), ["event_id", "path"], ["value"]).groupBy("status").agg(F.count("*").alias("n")), "select case when event_id % 3 = 0 then 'added' when event_id % 5 = 0 then 'removed' else 'unchanged' end as status, count(*) as n from events where not (event_id % 3 = 0 and event_id % 5 = 0) group by 1")


def _suppression_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    mark = F.when(F.col("turn") % 4 == 1, F.concat("text", F.lit(" check:off"))).when(F.col("turn") % 4 == 3, F.concat("text", F.lit(" check:on"))).otherwise(F.col("text"))
    return A.state_runs(c.withColumn("text", mark), "conv_id", "turn", "text", "check:off", "check:on").select("conv_id", "turn", "suppressed")


_add(
    "suppression_spans",
    _suppression_lines,
    """with c as (select conv_id, turn, max(text) as text from conversations group by 1, 2), s as (select *, case when text is null then null when turn % 4 = 1 then 1 when turn % 4 = 3 then 0 end as st from c)
    select conv_id, turn, coalesce(last_value(st ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) = 1, false) as suppressed from s""",
)
_add("snapshot_delta", lambda s, d: table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).select(F.col("day").cast("string").alias("day"), "n", (F.col("n") - F.lag("n").over(Window.orderBy("day"))).alias("delta")), "with d as (select cast(ts as date) as day, count(*) as n from events group by 1) select cast(day as varchar) as day, n, n - lag(n) over (order by day) as delta from d")


def _edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders are edits of their customer's file, each after the one before; some are not."""
    o = table(spark, sf_dir, "orders")
    older = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    before = F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("h"), F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(F.coalesce(older, F.lit(0)))))
    edits = o.select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("path"), before.alias("before"), F.concat(F.lit("h"), "o_orderkey").alias("after"))
    current = o.groupBy(F.col("o_custkey").alias("path")).agg(F.concat(F.lit("h"), F.max("o_orderkey")).alias("sha"))
    return edits, current.select("path", F.when(F.col("path") % 3 == 0, "other").when(F.col("path") % 5 != 0, F.col("sha")).alias("sha"))


_add(
    "undo_conflicts",
    lambda s, d: A.undo_conflicts(*_edits(s, d)),
    """with e as (select o_orderkey as task, o_custkey as path, case when o_orderkey % 11 <> 0 then 'h' || case when o_orderkey % 7 = 0 then -1 else coalesce(lag(o_orderkey) over (partition by o_custkey order by o_orderkey), 0) end end as before, 'h' || o_orderkey as after from orders),
    c as (select path, case when path % 3 = 0 then 'other' when path % 5 <> 0 then max(after) filter (task = m) end as sha from (select *, max(task) over (partition by path) as m from e) group by path),
    x as (select e.*, sha, lead(before) over (partition by e.path order by task) as newer, max(task) over (partition by e.path) = task as last from e join c on c.path = e.path),
    s as (select task, path, case when sha is null then 'gone' when (case when last then sha else newer end) is distinct from after then 'changed' when before is null then 'damaged' end as status from x) select * from s where status is not null""",
)
_add(
    "missing_keys",
    lambda s, d: A.missing_keys(table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit('{"a": 1}')).when(F.col("event_id") % 7 == 0, "no object").otherwise(F.col("props")).alias("props")), "event_id", "props", ["a", "k"]),
    "select event_id, 'a' as field from events where event_id % 3 <> 0 union all select event_id, 'k' from events where event_id % 3 = 0 or event_id % 7 = 0 or props is null",
)
