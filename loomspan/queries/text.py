"""Retrieval queries over documents, benchmark, conversations and part names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import text as X
from loomspan.operators import retrieval as R

from . import Query, spread, table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


_STOP = ", ".join(f"'{w}'" for w in X.STOP)


def _words(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 and w not in ({_STOP}))"


_TOKENS = f"t as (select doc_id, {_words('text')} as w from documents), x as (select doc_id, len(w) as dl, unnest(w) as token from t), c as (select doc_id, dl, token, count(*) as tf from x group by 1, 2, 3)"
QUESTION = "the thing that ering ering and thand of reth"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


_add(
    "text_tokens",
    lambda s, d: R.token_counts(documents(s, d)).groupBy("token").agg(F.sum("tf").alias("n"), F.count("*").alias("df")).where("df >= 5"),
    f"with {_TOKENS} select token, cast(sum(tf) as bigint) as n, count(*) as df from c group by token having count(*) >= 5",
)
for _name, _log in (("text_bm25_topk", False), ("text_bm25_log_topk", True)):
    _add(
        _name,
        lambda s, d, log=_log: R.bm25(documents(s, d), QUESTION, 20, log),
        f"""with {_TOKENS}, q as (select token, count(*) * count(*) as qf from (select unnest({_words(f"'{QUESTION}'")}) as token) group by token),
        l as (select count(*) as n, avg(len(w)) as avgdl from t), h as (select c.*, qf from c join q on q.token = c.token), f as (select token, count(*) as df from h group by token),
        s as (select doc_id, round(sum(qf * {"ln(1 + (n - df + 0.5) / (df + 0.5))" if _log else "greatest(0.0, (n - df + 0.5) / (df + 0.5))"} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from h join f on f.token = h.token, l group by doc_id)
        select * from s where score > 0 order by score desc, doc_id limit 20""",
    )
_add(
    "text_hash_embed",
    lambda s, d: R.hash_vectors(documents(s, d)).groupBy("dim").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("v")),
    f"""with {_TOKENS}, h as (select doc_id, ('0x' || substr(md5(token), 1, 8))::bigint % 256 as dim, case when ('0x' || substr(md5(token), 9, 2))::bigint % 2 = 1 then 1.0 else -1.0 end * tf as v from c),
    g as (select doc_id, dim, sum(v)::double as v from h group by 1, 2 having sum(v) <> 0), m as (select doc_id, dim, v / sqrt(sum(v * v) over (partition by doc_id)) as v from g) select dim, count(*) as n, round(sum(v), 6) as v from m group by dim""",
)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return R.hash_vectors(items).select(F.col("doc_id").alias("qid"), "dim", F.col("v").alias("q"))


_VEC = "select {k}, ('0x' || substr(md5(token), 1, 8))::bigint % 256 as dim, sum(case when ('0x' || substr(md5(token), 9, 2))::bigint % 2 = 1 then 1 else -1 end * tf)::double as v from {c} group by 1, 2 having v <> 0"
_add(
    "text_vector_topk",
    lambda s, d: R.vector_query(R.hash_vectors(documents(s, d)), _queries(s, d), 5).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank")),
    f"""with {_TOKENS}, bx as (select item_id, unnest({_words("text")}) as token from benchmark), bc as (select item_id, token, count(*) as tf from bx group by 1, 2),
    dv as (select doc_id, dim, v / sqrt(sum(v * v) over (partition by doc_id)) as v from ({_VEC.format(k="doc_id", c="c")})), qv as (select item_id as qid, dim, v / sqrt(sum(v * v) over (partition by item_id)) as q from ({_VEC.format(k="item_id", c="bc")})),
    s as (select qid, doc_id, round(sum(v * q), 6) as score from dv join qv on dv.dim = qv.dim group by 1, 2), k as (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from s where score > 0) select * from k where rank <= 5""",
)


def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors: ids divisible by 20, all vectors against each, in long form so that the join is on the dimension."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    norm = e.select("vec_id", F.transform("x", lambda v: v / F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, q: s + q * q))).alias("x"))
    q = norm.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("x").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, r: p * r), F.lit(0.0), lambda s, v: s + v)
    hits = norm.join(q, F.col("vec_id") != F.col("qid")).select("qid", "vec_id", F.round(dot, 6).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank.cast("long")).where("rank <= 5")


_add(
    "text_cosine_topk",
    _cosine,
    """with e as (select vec_id, cast(embedding as double[]) as x from embeddings), s as (select q.vec_id as qid, e.vec_id, round(list_inner_product(e.x, q.x) / sqrt(list_inner_product(e.x, e.x)) / sqrt(list_inner_product(q.x, q.x)), 6) as score from e join e q on q.vec_id % 20 = 0 and e.vec_id <> q.vec_id),
    k as (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from s where score > 0) select qid, vec_id, score, rank from k where rank <= 5""",
)
_add(
    "text_overlap_score",
    lambda s, d: R.field_overlap(documents(s, d).withColumn("title", F.substring_index("text", "\n", 1)), QUESTION, {"title": 2.0, "text": 1.5, "source": 3.0}, "doc_id").orderBy(F.desc("score"), "doc_id").limit(50),
    "with d as (select doc_id, text, source, string_split(text, chr(10))[1] as title from documents), q as (select list_distinct(" + _words(f"'{QUESTION}'") + ") as q), w as (select doc_id, q, list_distinct(" + _words("title") + ") as a, list_distinct(" + _words("text") + ") as b, list_distinct(" + _words("source") + ") as c from d, q) select doc_id, round(case when len(a) > 0 then 2.0 * len(list_intersect(a, q)) / sqrt(len(a)) else 0 end + case when len(b) > 0 then 1.5 * len(list_intersect(b, q)) / sqrt(len(b)) else 0 end + case when len(c) > 0 then 3.0 * len(list_intersect(c, q)) / sqrt(len(c)) else 0 end, 6) as score from w where score > 0 order by score desc, doc_id limit 50",
)
_PARTS = "list_transform(regexp_extract_all(p_name, '[A-Za-z]+|[0-9]+'), lambda w: lower(w))"


def part_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    return R.fragments(names, "p_partkey", "name")


_add("text_fragments", lambda s, d: part_fragments(s, d).groupBy("fragment").agg(F.count("*").alias("n")), f"with f as (select p_partkey, unnest(list_distinct({_PARTS})) as fragment from part) select fragment, count(*) as n from f group by fragment")
_add("text_fragment_match", lambda s, d: R.by_fragments(part_fragments(s, d), "p_partkey", ["b", "r"]), f"with f as (select p_partkey, unnest(list_distinct({_PARTS})) as fragment from part) select p_partkey from f group by p_partkey having count_if(fragment like 'b%') > 0 and count_if(fragment like 'r%') > 0")
_add(
    "text_identifier_parts",
    lambda s, d: table(s, d, "customer").select("c_custkey", F.array_join(X.identifier_parts(F.concat("c_name", F.lit("HTTPServer2x"))), "|").alias("parts")),
    "select c_custkey, array_to_string(list_transform(regexp_extract_all(c_name, '[A-Z][a-z]*|[a-z]+|[0-9]+'), lambda w: lower(w)), '|') || '|http|server|2|x' as parts from customer",
)
_add(
    "text_intent",
    lambda s, d: table(s, d, "conversations").groupBy(X.intent(F.concat(F.when(F.col("turn") % 3 == 0, "Who calls ").when(F.col("turn") % 3 == 1, "Explain ").otherwise("Tell "), F.coalesce("text", F.lit("")))).alias("intent")).agg(F.count("*").alias("n")),
    """with q as (select lower(case when turn % 3 = 0 then 'Who calls ' when turn % 3 = 1 then 'Explain ' else 'Tell ' end || coalesce(text, '')) as q from conversations),
    i as (select case when regexp_matches(q, 'who calls|callers? of|called by') then 'callers' when regexp_matches(q, 'what does .* call|callees? of|calls to') then 'callees' when regexp_matches(q, 'risk|danger|hot ?spot|priority') then 'risk' when regexp_matches(q, 'explain|what is|how does') then 'explain' else 'retrieve' end as intent from q) select intent, count(*) as n from i group by intent""",
)
_add(
    "text_subject",
    lambda s, d: R.find_subject(table(s, d, "nation").select(F.col("n_name").alias("name")), "who calls nation_7 and nation_12 now").unionByName(R.find_subject(table(s, d, "region").select(F.col("r_name").alias("name")), "is asia, or africa larger")),
    """with n as (select distinct n_name as name from nation where regexp_matches(' who calls nation_7 and nation_12 now ', '[^a-z0-9_]' || lower(n_name) || '[^a-z0-9_]')), r as (select distinct r_name as name from region where regexp_matches(' is asia, or africa larger ', '[^a-z0-9_]' || lower(r_name) || '[^a-z0-9_]'))
    (select name from n order by length(name) desc, name limit 1) union all (select name from r order by length(name) desc, name limit 1)""",
)
_add(
    "text_search",
    lambda s, d: R.search_lines(documents(s, d), r"\bpass\w*|\bsecret", regex=True),
    r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as content, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from documents),
    h as (select doc_id, line, regexp_extract_all(content, '(?i)(?:^|[^\p{L}\p{N}_])(pass[\p{L}\p{N}_]*|secret)') as m, regexp_extract_all(content, '(?i)(?:^|[^\p{L}\p{N}_])(pass[\p{L}\p{N}_]*|secret)', 1) as w, string_split_regex(content, '(?i)(?:^|[^\p{L}\p{N}_])(pass[\p{L}\p{N}_]*|secret)') as s from l where regexp_matches(content, '(?i)(?:^|[^\p{L}\p{N}_])(pass[\p{L}\p{N}_]*|secret)')),
    x as (select *, unnest(range(1, len(m) + 1)) as i from h)
    select doc_id, line, cast(1 + length(array_to_string(s[1:i], '')) + length(array_to_string(m[1:i], '')) - length(w[i]) as bigint) as col, w[i] as match from x""",
)


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("token"))
    return lines.where(F.length("token") > 3).distinct()


_LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as token from documents), s as (select distinct doc_id, token from l where length(token) > 3), z as (select doc_id, count(*) as n from s group by doc_id)"
_add(
    "clone_jaccard",
    lambda s, d: R.jaccard_pairs(_sets(s, d), 0.8),
    f"with {_LINES}, p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.token = b.token and a.doc_id < b.doc_id group by 1, 2) select p.a, p.b, round(k / (x.n + y.n - k), 6) as jaccard from p join z x on x.doc_id = p.a join z y on y.doc_id = p.b where k / (x.n + y.n - k) >= 0.8",
)


def _line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.length("line") > 3)


_add(
    "clone_fragment",
    lambda s, d: R.line_runs(_line_rows(s, d), 4).select("a", "b", F.col("start_a").cast("long").alias("start_a"), F.col("start_b").cast("long").alias("start_b"), "n"),
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents), k as (select * from l where length(line) > 3),
    s as (select a.doc_id as a, b.doc_id as b, a.pos as pa, b.pos as pb, a.pos - b.pos as g from k a join k b on a.line = b.line and a.doc_id < b.doc_id), i as (select *, pa - row_number() over (partition by a, b, g order by pa) as island from s)
    select a, b, min(pa) as start_a, min(pb) as start_b, count(*) as n from i group by a, b, g, island having count(*) >= 4""",
)


def _best_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of similar lines of documents that aren't alike as a whole; short lines are left out before lines are numbered."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    lines = _line_rows(spark, sf_dir).select("doc_id", (at - 1).cast("long").alias("pos"), "line")
    whole = R.jaccard_pairs(_sets(spark, sf_dir), 0.8)
    return R.similar_runs(lines, 4, 0.92).join(whole, ["a", "b"], "left_anti")


_add(
    "clone_fragment_similar",
    _best_blocks,
    f"""with {_LINES}, p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.token = b.token and a.doc_id < b.doc_id group by 1, 2), alike as (select p.a, p.b from p join z x on x.doc_id = p.a join z y on y.doc_id = p.b where k / (x.n + y.n - k) >= 0.8),
    u as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as place from documents), k as (select doc_id, line, row_number() over (partition by doc_id order by place) - 1 as pos from u where length(line) > 3),
    q as (select a.doc_id as a, b.doc_id as b, a.pos as pa, a.pos - b.pos as g from k a join k b on a.line = b.line and a.doc_id < b.doc_id), i as (select *, pa - row_number() over (partition by a, b, g order by pa) as island from q),
    r as (select a, b, g, min(pa) as start_a, count(*) as n from i group by a, b, g, island), c as (select *, cast(sum(n) over (partition by a, b, g order by start_a) as bigint) as upto from r),
    w as (select x.a, x.b, x.g, x.start_a, y.start_a + y.n - x.start_a as n, y.upto - x.upto + x.n as same from c x join c y on x.a = y.a and x.b = y.b and x.g = y.g and y.start_a >= x.start_a),
    best as (select *, row_number() over (partition by a, b order by n desc, same desc, start_a, g desc) as rank from w where n >= 4 and same >= 0.92 * n - 1e-9)
    select a, b, start_a, start_a - g as start_b, n, same from best where rank = 1 and not exists (select 1 from alike where alike.a = best.a and alike.b = best.b)""",
)


def _mangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    whole = F.concat(F.length(a), a, F.length(b), b)
    name = F.when(F.col("p_size") % 5 == 0, "_Z99x").when(F.col("p_size") % 3 == 0, F.concat(F.lit("_Z"), F.length(a), a, F.lit("IiLb0EE"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("_ZN"), whole, F.lit("Ei"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


_add(
    "demangled_names",
    lambda s, d: _mangled(s, d).select("p_partkey", X.demangled(F.col("name")).alias("readable")),
    "select p_partkey, case when p_size % 5 = 0 then '' when p_size % 3 = 0 then string_split(p_name, ' ')[1] || '<...>' when p_size % 3 = 1 then string_split(p_name, ' ')[1] || '::' || string_split(p_name, ' ')[-1] else '' end as readable from part",
)
