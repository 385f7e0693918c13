"""Attribution queries: suppliers and customers stand for libraries, parts for names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.text import candidate_names, library_family
from loomspan.operators import attribution as A

from . import Query, table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers export the parts that they ship in large quantity."""
    return table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.concat(F.lit("fn_"), F.col("l_partkey")).alias("name"), F.concat(F.lit("lib"), F.col("l_suppkey"), F.lit(".so")).alias("path"))


def kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 45").select(F.concat(F.lit("fn_"), F.col("p_partkey")).alias("name"), F.col("p_brand").alias("path"))


_E = "e as (select distinct 'fn_' || l_partkey as name, 'lib' || l_suppkey || '.so' as path from lineitem where l_quantity >= 48), k as (select distinct 'fn_' || p_partkey as name, p_brand as path from part where p_size > 45)"


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_partkey") % 4 == 0, "my_").otherwise(""), F.lit("fn_"), F.col("p_partkey")).alias("name"))


_add(
    "attr_three_state",
    lambda s, d: A.attribute(_wanted(s, d), exports(s, d), kernels(s, d), "my_").select("name", "status", F.array_join("origins", ",").alias("origins")),
    f"""with {_E}, w as (select case when p_partkey % 4 = 0 then 'my_' else '' end || 'fn_' || p_partkey as name from part), b as (select name, case when name like 'my\\_%' escape '\\' then substr(name, 4) else name end as bare from w),
    ge as (select name, string_agg(path, ',' order by path) as o from e group by name), gk as (select name, string_agg(path, ',' order by path) as o from k group by name)
    select b.name, case when ge.o is not null then 'library' when gk.o is not null then 'kernel' else 'missing' end as status, coalesce(ge.o, gk.o, '') as origins from b left join ge on ge.name = b.bare left join gk on gk.name = b.bare""",
)
_add("attr_conflicts", lambda s, d: A.conflicts(exports(s, d)).select("name", F.size("paths").cast("long").alias("n")), f"with {_E} select name, count(*) as n from e group by name having count(*) > 1")


def _deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_custkey") % 11 == 0, "rpath").otherwise("needed")
    return c.select(F.col("c_name").alias("path"), F.concat(F.lit("/usr/lib/lib"), F.lower("c_mktsegment"), F.lit("."), F.lit("so."), F.col("c_custkey") % 4).alias("name"), kind.alias("kind"))


_add(
    "dep_missing",
    lambda s, d: A.missing_dependencies(_deps(s, d), table(s, d, "customer").where("c_mktsegment < 'F'").select(F.concat(F.lower("c_mktsegment"), F.lit("-2.dll")).alias("name"))),
    "select c_name as path, '/usr/lib/lib' || lower(c_mktsegment) || '.so.' || (c_custkey % 4) as name, lower(c_mktsegment) as family from customer where c_custkey % 11 <> 0 and c_mktsegment not in (select c_mktsegment from customer where c_mktsegment < 'F')",
)
_add(
    "library_family",
    lambda s, d: table(s, d, "supplier").select("s_suppkey", library_family(F.concat(F.when(F.col("s_suppkey") % 3 == 0, "C:\\x\\").otherwise("/opt/lib"), F.lit("Net"), F.lit("core"), F.when(F.col("s_suppkey") % 2 == 0, ".so.1.2").when(F.col("s_suppkey") % 3 == 0, "-3.dll").otherwise(".1.dylib"))).alias("family")),
    "select s_suppkey, 'netcore' as family from supplier",
)
_add("candidate_names", lambda s, d: table(s, d, "nation").select("n_nationkey", F.explode(candidate_names(F.lower("n_name"))).alias("candidate")), "select n_nationkey, unnest(['lib' || lower(n_name) || '.so', 'lib' || lower(n_name) || '.dylib', lower(n_name) || '.dll', lower(n_name) || '.lib', lower(n_name)]) as candidate from nation")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "lib").otherwise("Lib"), F.lit("x"), F.chr(F.col("s_suppkey") % 20 + 97), F.lit(".so"))
    return s.select(F.concat(F.lit("/"), F.col("s_nationkey"), F.lit("/"), name).alias("path"), name.alias("file"), F.when(F.col("s_suppkey") % 3 == 0, 32).otherwise(64).alias("bits"), F.concat(F.lit("/r/"), F.col("s_suppkey") % 30).alias("real"))


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(26).select(F.concat(F.lit("libx"), F.chr(F.col("id") + 97), F.when(F.col("id") % 5 == 0, ".so.1").otherwise(".so")).alias("ref"), F.when(F.col("id") % 2 == 0, 32).otherwise(64).alias("bits"))


_add(
    "resolve_candidates",
    lambda s, d: A.resolve_candidates(_refs(s, d), _files(s, d)).select("ref", "bits", "status", "real"),
    """with f as (select case when s_suppkey % 2 = 0 then 'lib' else 'Lib' end || 'x' || chr(cast(s_suppkey % 20 + 97 as int)) || '.so' as file, case when s_suppkey % 3 = 0 then 32 else 64 end as bits, '/r/' || (s_suppkey % 30) as re from supplier),
    r as (select 'libx' || chr(cast(i + 97 as int)) || case when i % 5 = 0 then '.so.1' else '.so' end as ref, case when i % 2 = 0 then 32 else 64 end as want, 'x' || chr(cast(i + 97 as int)) as fam from range(26) t(i)),
    h as (select ref, want, re, bits, case when ref = file then 1 when lower(ref) = lower(file) then 2 else 3 end as rung from r join f on lower(f.file) = 'lib' || fam || '.so'),
    b as (select * from h qualify rung = min(rung) over (partition by ref, want)),
    n as (select ref, want, count(distinct re) as n, min(re) as one, count(distinct case when bits = want then re end) as nf, min(case when bits = want then re end) as onef from b group by 1, 2)
    select r.ref, r.want as bits, case when n.n is null then 'not_found' when n.n = 1 or nf = 1 then 'found' else 'ambiguous' end as status, case when n.n = 1 then one when nf = 1 then onef end as real from r left join n on n.ref = r.ref and n.want = r.want""",
)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier")
    deps = n.select(F.col("s_suppkey").alias("path"), F.explode(F.array((F.col("s_suppkey") * 2) % 97 + 1, (F.col("s_suppkey") * 3) % 89 + 1)).alias("needs"))
    found, cut_short = A.dependency_levels(n.where("s_suppkey = 1").select(F.col("s_suppkey").alias("path")), deps, 4, 10_000)
    return found.withColumn("truncated", F.lit(cut_short))


_add(
    "dep_bfs",
    _levels,
    """with recursive d as (select s_suppkey as path, unnest([(s_suppkey * 2) % 97 + 1, (s_suppkey * 3) % 89 + 1]) as needs from supplier), r(path, level) as (select cast(1 as bigint), 0 union select d.needs, level + 1 from r join d on d.path = r.path where level < 4),
    m as (select path, cast(min(level) as int) as level from r group by path), x as (select count(*) > 0 as truncated from m join d on d.path = m.path where m.level = 4 and d.needs not in (select path from m)) select path, level, truncated from m, x""",
)
