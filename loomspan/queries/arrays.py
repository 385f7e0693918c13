"""Array operators: the packed catalogue over embeddings (64 values, also as an 8 by 8 matrix), long form over lineitem, Q15, loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import ieee, q15
from loomspan.operators import tensor as T

from . import Query, table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

CLEAN = "case when isnan(v) then null when isinf(v) then sign(v) * 1e300 else round(v, 6) + 0.0 end"


def clean(v: Column) -> Column:
    """Rounded for comparison; NaN is null and infinities are large numbers."""
    finite = F.round(v, 6) + F.lit(0.0)
    return F.when(F.isnan(v), None).when(ieee.is_inf(v), F.signum(v) * 1e300).otherwise(finite)


def _packed(name: str, make: Callable[[Column, Column], Column], sql: str, cols: str = "64") -> None:
    """make: from the vector x and the matrix a of a row to a tensor. sql: the list of its values by row, from x."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
        out = df.select("vec_id", make(T.tensor(F.col("x")), T.tensor(F.col("x"), 8, 8)).alias("t"))
        flat = out.select("vec_id", F.col("t.cols").alias("c"), F.posexplode("t.data").alias("k", "v"))
        return flat.select("vec_id", (F.floor(F.col("k") / F.col("c")) + 1).cast("long").alias("i"), (F.col("k") % F.col("c") + 1).cast("long").alias("j"), clean(F.col("v")).alias("v"))

    QUERIES[name] = query
    ORACLE[name] = f"""
        with e as (select vec_id, cast(embedding as double[]) as x from embeddings),
        r as (select vec_id, {sql} as l from e),
        u as (select vec_id, len(l) as n, unnest(l) as v, unnest(range(len(l))) as k from r)
        select vec_id, cast(k // ({cols}) + 1 as bigint) as i, cast(k % ({cols}) + 1 as bigint) as j, {CLEAN} as v from u
    """


def _each(expr: str, n: int = 64) -> str:
    """A list of expr for k from 0."""
    return f"list_transform(range({n}), lambda k: cast({expr} as double))"


def _one(expr: str) -> str:
    return f"[cast({expr} as double)]"


C = T.CATALOGUE
_rev = lambda x: T.unary(T.tensor(F.reverse(x["data"])), lambda v: v)
_coarse = lambda x: T.unary(x, lambda v: F.round(v * 2, 0))
_first_row = lambda a: T.row(a, F.lit(1))
_special = lambda x: T.tensor(F.transform(x["data"], lambda v, k: F.when(k % 7 == 0, F.lit(ieee.NAN)).when(k % 5 == 0, F.signum(v) * F.lit(ieee.INF)).otherwise(v)))
_SPECIAL = _each("case when k % 7 = 0 then 'nan'::double when k % 5 = 0 then sign(x[k + 1]) * 'inf'::double else x[k + 1] end")

_packed("op_add", lambda x, a: C["OP-ADD"](a, _first_row(a)), _each("x[k + 1] + x[k % 8 + 1]"), "8")
_packed("op_sub", lambda x, a: C["OP-SUB"](x, _rev(x)), _each("x[k + 1] - x[64 - k]"))
_packed("op_mul", lambda x, a: C["OP-MUL"](x, _rev(x)), _each("x[k + 1] * x[64 - k]"))
_packed("op_div", lambda x, a: C["OP-DIV"](x, _coarse(_rev(x))), _each("case when round(x[64 - k] * 2) = 0 then case when x[k + 1] = 0 then 'nan'::double else sign(x[k + 1]) * 'inf'::double end else x[k + 1] / round(x[64 - k] * 2) end"))
_packed("op_mod", lambda x, a: C["OP-MOD"](T.unary(x, lambda v: v * 10), T.unary(_rev(x), lambda v: F.when(v < 0, F.lit(-3.0)).otherwise(F.lit(2.5)))), _each("x[k + 1] * 10 - (case when x[64 - k] < 0 then -3.0 else 2.5 end) * floor(x[k + 1] * 10 / (case when x[64 - k] < 0 then -3.0 else 2.5 end))"))
for _name, _sql in {
    "abs": "abs(x[k + 1])", "exp": "exp(x[k + 1])", "sin": "sin(x[k + 1])", "cos": "cos(x[k + 1])", "tan": "tan(x[k + 1])",
    "floor": "floor(x[k + 1])", "ceil": "ceil(x[k + 1])", "round": "sign(x[k + 1]) * floor(abs(x[k + 1]) + 0.5)",
}.items():
    _packed(f"op_{_name}", lambda x, a, op=f"OP-{_name.upper()}": C[op](x), _each(_sql))
_packed("op_sqrt", lambda x, a: C["OP-SQRT"](x), _each("case when x[k + 1] < 0 then 'nan'::double else sqrt(abs(x[k + 1])) end"))
for _name, _f in (("log", "ln"), ("log2", "log2"), ("log10", "log10")):
    _packed(f"op_{_name}", lambda x, a, op=f"OP-{_name.upper()}": C[op](T.unary(x, lambda v: F.when(v > 1, F.lit(0.0)).otherwise(v))), _each(f"case when x[k + 1] > 1 or x[k + 1] = 0 then '-inf'::double when x[k + 1] < 0 then 'nan'::double else {_f}(abs(x[k + 1]) + 0.0) end"))
_packed("op_isnan", lambda x, a: C["OP-ISNAN"](_special(x)), _each("case when k % 7 = 0 then 1 else 0 end"))
_packed("op_isinf", lambda x, a: C["OP-ISINF"](_special(x)), _each("case when k % 7 <> 0 and k % 5 = 0 and x[k + 1] <> 0 then 1 else 0 end"))
_packed("op_isreal", lambda x, a: C["OP-ISREAL"](x), _one("1"), "1")
_packed("op_isnumeric", lambda x, a: C["OP-ISNUMERIC"](x), _one("1"), "1")
_packed("op_sum", lambda x, a: C["OP-SUM"](a), _each("list_sum(list_transform(range(8), lambda i: x[i * 8 + k + 1]))", 8), "8")
_packed("op_mean", lambda x, a: C["OP-MEAN"](a), _each("list_sum(list_transform(range(8), lambda i: x[i * 8 + k + 1])) / 8", 8), "8")
_packed("op_max", lambda x, a: C["OP-MAX"](a), _each("list_max(list_transform(range(8), lambda i: x[i * 8 + k + 1]))", 8), "8")
_packed("op_min", lambda x, a: C["OP-MIN"](a), _each("list_min(list_transform(range(8), lambda i: x[i * 8 + k + 1]))", 8), "8")
_packed("op_max_nan", lambda x, a: C["OP-MAX"](_special(x)), _one(f"list_max(list_filter({_SPECIAL}, lambda q: not isnan(q)))"), "1")
_packed("op_prod", lambda x, a: C["OP-PROD"](T.slice_(x, 1, 8)), _one("list_product(x[1:8])"), "1")
_packed("op_any", lambda x, a: C["OP-ANY"](_coarse(x)), _one("case when len(list_filter(x, lambda q: round(q * 2) <> 0)) > 0 then 1 else 0 end"), "1")
_packed("op_all", lambda x, a: C["OP-ALL"](_coarse(T.slice_(x, 1, 2))), _one("case when round(x[1] * 2) <> 0 and round(x[2] * 2) <> 0 then 1 else 0 end"), "1")
_packed("op_nnz", lambda x, a: C["OP-NNZ"](_coarse(x)), _one("len(list_filter(x, lambda q: round(q * 2) <> 0))"), "1")
_packed("op_size", lambda x, a: T.size_all(C["OP-COLRANGE"](a, 2, 4)), "[8.0, 3.0]", "2")
_packed("op_size_dim", lambda x, a: C["OP-SIZE"](x, 2), _one("len(x)"), "1")
_packed("op_numel", lambda x, a: C["OP-NUMEL"](a), _one("len(x)"), "1")
_packed("op_length", lambda x, a: C["OP-LENGTH"](C["OP-COLRANGE"](a, 2, 4)), _one("8"), "1")
_packed("op_isempty", lambda x, a: C["OP-ISEMPTY"](C["OP-MASK"](x, 0, 2.0)), _one("case when len(list_filter(x, lambda q: q > 2)) = 0 then 1 else 0 end"), "1")
_packed("op_isequal", lambda x, a: C["OP-ISEQUAL"](_coarse(T.slice_(x, 1, 2)), _coarse(T.slice_(x, 3, 4))), _one("case when round(x[1] * 2) = round(x[3] * 2) and round(x[2] * 2) = round(x[4] * 2) then 1 else 0 end"), "1")
_packed("op_isequalk", lambda x, a: C["OP-ISEQUALK"](C["OP-INDEX"](_coarse(x), F.lit(1)), 0.0), _one("case when round(x[1] * 2) = 0 then 1 else 0 end"), "1")
_packed("op_index", lambda x, a: C["OP-INDEX"](a, F.lit(11)), _one("x[18]"), "1")
_packed("op_idx2", lambda x, a: C["OP-IDX2"](a, F.lit(3), F.lit(5)), _one("x[21]"), "1")
_packed("op_setidx", lambda x, a: C["OP-SETIDX"](x, F.lit(5), F.lit(9.5)), _each("case when k = 4 then 9.5 else x[k + 1] end"))
_packed("op_setidx2", lambda x, a: C["OP-SETIDX2"](a, F.lit(3), F.lit(5), F.lit(-1.0)), _each("case when k = 20 then -1 else x[k + 1] end"), "8")
_packed("op_row", lambda x, a: C["OP-ROW"](a, F.lit(3)), "x[17:24]", "8")
_packed("op_col", lambda x, a: C["OP-COL"](a, F.lit(2)), _each("x[k * 8 + 2]", 8), "8")
_packed("op_colrange", lambda x, a: C["OP-COLRANGE"](a, 6, -1), _each("x[k // 3 * 8 + k % 3 + 6]", 24), "3")
_packed("op_slice", lambda x, a: C["OP-SLICE"](x, 5, 20), "x[5:20]", "16")
_packed("op_range", lambda x, a: C["OP-RANGE"](F.lit(3), F.lit(9)), "[3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]", "1")
_packed("op_fill", lambda x, a: C["OP-FILLA"](1.0, 2, 3), "[1.0, 1.0, 1.0, 1.0, 1.0, 1.0]", "3")
_packed("op_copy", lambda x, a: C["OP-COPY"](a), "x", "8")
_packed("op_hcat", lambda x, a: C["OP-HCAT"](x, _rev(x)), "list_concat(x, list_reverse(x))", "128")
_packed("op_vcat", lambda x, a: C["OP-VCAT"](a, _first_row(a)), "list_concat(x, x[1:8])", "8")
_packed("op_flatten", lambda x, a: C["OP-FLATTEN"](a), _each("x[k % 8 * 8 + k // 8 + 1]"))
_packed("op_transpose", lambda x, a: C["OP-TRANSPOSE"](C["OP-COLRANGE"](a, 1, 4)), _each("x[k % 8 * 8 + k // 8 + 1]", 32), "8")
_packed("op_mask", lambda x, a: C["OP-MASK"](x, 0, 0.1), "list_filter(x, lambda q: q > 0.1)", "n")
_packed("op_find", lambda x, a: C["OP-FIND"](x, 2, 0.0), "list_transform(list_filter(range(64), lambda k: x[k + 1] < 0), lambda k: cast(k + 1 as double))", "n")
_packed("op_find2", lambda x, a: C["OP-FIND2"](x, _rev(x), 1), "list_transform(list_filter(range(64), lambda k: x[k + 1] >= x[64 - k]), lambda k: cast(k + 1 as double))", "n")
_packed("op_find3", lambda x, a: C["OP-FIND3"](x, 0, 0.0, 5), "list_transform(list_filter(range(64), lambda k: x[k + 1] > 0)[1:5], lambda k: cast(k + 1 as double))", "n")
_packed("op_setdiff", lambda x, a: C["OP-SETDIFF"](T.unary(x, lambda v: F.round(v * 4, 0) + 0.0), T.tensor(F.array(F.lit(0.0), F.lit(1.0)))), "list_sort(list_filter(list_distinct(list_transform(x, lambda q: round(q * 4) + 0.0)), lambda q: q <> 0 and q <> 1))", "n")
_packed("op_matmul", lambda x, a: C["OP-MATMUL"](a, T.transpose(a)), _each("list_sum(list_transform(range(8), lambda i: x[k // 8 * 8 + i + 1] * x[k % 8 * 8 + i + 1]))"), "8")


# long form: one row an element


def _long(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i: order, j: line number, v: summed quantity."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("i"), F.col("l_linenumber").cast("long").alias("j")).agg(F.sum("l_quantity").alias("v"))


_M = "m as (select l_orderkey as i, cast(l_linenumber as bigint) as j, sum(l_quantity) as v from lineitem group by 1, 2)"
for _name, _how, _sql in (("sum", F.sum, "sum(v)"), ("mean", F.avg, "avg(v)"), ("max", F.max, "max(v)"), ("min", F.min, "min(v)")):
    _long(f"op_{_name}_col", lambda s, d, how=_how: T.long_reduce(matrix(s, d), how).select("j", F.round("v", 6).alias("v")), f"with {_M} select j, round({_sql}, 6) as v from m group by j")
_long("long_transpose", lambda s, d: T.long_transpose(matrix(s, d)), f"with {_M} select j as i, i as j, v from m")
_long(
    "long_matmul",
    lambda s, d: T.long_matmul(T.long_transpose(matrix(s, d)), matrix(s, d)).select("i", "j", F.round("v", 4).alias("v")),
    f"with {_M} select a.j as i, b.j as j, round(sum(a.v * b.v), 4) as v from m a join m b on a.i = b.i group by 1, 2",
)
_long(
    "long_broadcast_sub",
    lambda s, d: T.long_elementwise(matrix(s, d), T.long_reduce(matrix(s, d), F.avg), lambda x, y: F.round(x - y, 6) + F.lit(0.0), ("j",)),
    f"with {_M}, c as (select j, avg(v) as y from m group by j) select i, m.j, round(v - y, 6) + 0.0 as v from m join c on m.j = c.j",
)
_long(
    "long_vcat",
    lambda s, d: T.long_vcat(matrix(s, d).where("j = 1"), matrix(s, d).where("j = 2"), 1_000_000_000),
    f"with {_M} select i, j, v from m where j = 1 union all select i + 1000000000, j, v from m where j = 2",
)
_long("long_mask", lambda s, d: matrix(s, d).where("v > 45"), f"with {_M} select i, j, v from m where v > 45")
_long(
    "long_find",
    lambda s, d: T.numbered(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey").where("o_totalprice > 150000").select("i", F.col("o_totalprice").alias("v")),
    "with n as (select row_number() over (order by o_orderkey) as i, o_totalprice as v from orders) select i, v from n where v > 150000",
)
_long(
    "long_setdiff",
    lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("v")).where("v % 3 <> 0").subtract(table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("v"))),
    "select o_custkey as v from orders where o_custkey % 3 <> 0 except select o_custkey from orders where o_totalprice > 300000",
)

# Q15: discount and tax as fractions, quantity as a factor



def _fixed() -> dict[str, Column]:
    return {"a": q15.quantise(F.col("l_discount") * 8 - 0.4), "b": q15.quantise(F.col("l_tax") * 9 - 0.3)}


_KEYS = ("l_orderkey", "l_linenumber", "l_partkey")
_QSQL = "q as (select l_orderkey, l_linenumber, l_partkey, l_returnflag, cast(greatest(least(sign(x) * floor(abs(x) + 0.5), 32767), -32768) as bigint) as a, cast(greatest(least(sign(y) * floor(abs(y) + 0.5), 32767), -32768) as bigint) as b from (select *, (l_discount * 8 - 0.4) * 32768 as x, (l_tax * 9 - 0.3) * 32768 as y from lineitem))"


def _q15(name: str, f: Callable[[Column, Column], Column], sql: str) -> None:
    _long(f"q15_{name}", lambda s, d: table(s, d, "lineitem").withColumns(_fixed()).select(*_KEYS, f(F.col("a"), F.col("b")).alias("r")), f"with {_QSQL} select l_orderkey, l_linenumber, l_partkey, {sql} as r from q")


_SAT = "cast(greatest(least({}, 32767), -32768) as bigint)"
_q15("quantise", lambda a, b: a, "a")
_q15("to_double", lambda a, b: q15.to_double(a), "a / 32768.0::double")
_q15("add", q15.add, _SAT.format("a + b"))
_q15("sub", q15.sub, _SAT.format("a - b"))
_q15("mul", q15.mul, _SAT.format("cast(trunc((a * b + 16384) / 32768.0::double) as bigint)"))
_q15("div", lambda a, b: q15.div(a, F.when(b == 0, 1).otherwise(b).cast("long")), _SAT.format("(case when (a < 0) <> ((case when b = 0 then 1 else b end) < 0) then -1 else 1 end) * ((abs(a) * 32768 + abs(case when b = 0 then 1 else b end) // 2) // abs(case when b = 0 then 1 else b end))"))
for _name, _f, _sql in (
    ("sum", q15.sum_, _SAT.format("sum(a)")),
    ("mean", q15.mean, _SAT.format("cast(trunc(sum(a) / cast(count(a) as double)) as bigint)")),
    ("max", q15.max_, "max(a)"),
    ("min", q15.min_, "min(a)"),
):
    _long(f"q15_{_name}", lambda s, d, f=_f: table(s, d, "lineitem").withColumns(_fixed()).groupBy("l_returnflag").agg(f(F.col("a")).alias("r")), f"with {_QSQL} select l_returnflag, {_sql} as r from q group by l_returnflag")

# loops as folds and windows, over the orders of each customer in key order


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("v"))


def _by():  # noqa: ANN202
    return Window.partitionBy("o_custkey").orderBy("o_orderkey")


_long(
    "loop_moving_avg",
    lambda s, d: _series(s, d).select("o_custkey", "o_orderkey", F.round(F.avg("v").over(_by().rowsBetween(-3, 0)), 4).alias("avg_v")),
    "select o_custkey, o_orderkey, round(avg(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 3 preceding and current row), 4) as avg_v from orders",
)
_long(
    "ext_prefix_sum",
    lambda s, d: _series(s, d).select("o_custkey", "o_orderkey", F.round(F.sum("v").over(_by().rowsBetween(Window.unboundedPreceding, 0)), 4).alias("run_v")),
    "select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows unbounded preceding), 4) as run_v from orders",
)


def _packed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order prices in key order, as an array."""
    return _series(spark, sf_dir).groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "v"))), lambda r: r["v"]).alias("x"))


_long(
    "loop_accumulate",
    lambda s, d: _packed_series(s, d).select("o_custkey", F.round(F.aggregate(F.col("x"), F.lit(0.0), lambda a, v: a * 0.3 + v), 2).alias("acc")),
    "with x as (select o_custkey, o_totalprice as v, row_number() over (partition by o_custkey order by o_orderkey desc) - 1 as k from orders) select o_custkey, round(sum(v * pow(0.3, k)), 2) as acc from x group by o_custkey",
)
_long("loop_copy", lambda s, d: _packed_series(s, d).select("o_custkey", F.posexplode(F.transform("x", lambda v: v)).alias("k", "v")).select("o_custkey", F.col("k").cast("long").alias("k"), "v"), "select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as k, o_totalprice as v from orders")
_long("loop_colmax", lambda s, d: _packed_series(s, d).select("o_custkey", F.aggregate(F.col("x"), F.element_at("x", 1), lambda a, v: F.when(v > a, v).otherwise(a)).alias("top")), "select o_custkey, max(o_totalprice) as top from orders group by o_custkey")
_long("loop_pickmax", lambda s, d: _series(s, d).groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("v", -F.col("o_orderkey"))).alias("o_orderkey")), "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1")
_TAPS = (0.25, 0.5, 0.25)
_long(
    "loop_fir",
    lambda s, d: _series(s, d).select("o_custkey", "o_orderkey", F.round(sum(F.lag("v", k).over(_by()) * t for k, t in enumerate(_TAPS)) / (1 + abs(0.5)), 4).alias("y")).where("y is not null"),
    "select o_custkey, o_orderkey, round((0.25 * o_totalprice + 0.5 * lag(o_totalprice, 1) over w + 0.25 * lag(o_totalprice, 2) over w) / 1.5, 4) as y from orders window w as (partition by o_custkey order by o_orderkey) qualify lag(o_totalprice, 2) over w is not null",
)
_packed("kern_dot", lambda x, a: T.matmul(x, T.transpose(x)), _one("list_sum(list_transform(x, lambda q: q * q))"), "1")
_packed("kern_relu", lambda x, a: T.unary(x, lambda v: F.greatest(v, F.lit(0.0))), _each("greatest(x[k + 1], 0)"))
_packed("kern_clip", lambda x, a: T.unary(x, lambda v: F.least(F.greatest(v, F.lit(-0.5)), F.lit(0.5))), _each("least(greatest(x[k + 1], -0.5), 0.5)"))
_packed("kern_lerp", lambda x, a: T.elementwise(x, _rev(x), lambda p, q: p + (q - p) * 0.25), _each("x[k + 1] + (x[64 - k] - x[k + 1]) * 0.25"))
_packed("kern_energy", lambda x, a: T.sum_(T.unary(x, lambda v: v * v)), _one("list_sum(list_transform(x, lambda q: q * q))"), "1")
_packed("kern_snr", lambda x, a: T.elementwise(T.sum_(T.unary(T.slice_(x, 1, 32), lambda v: v * v)), T.sum_(T.unary(T.slice_(x, 33, 64), lambda v: v * v)), lambda p, n: 10 * ieee.ieee_log10(ieee.ieee_div(p, n))), _one("10 * log10(list_sum(list_transform(x[1:32], lambda q: q * q)) / list_sum(list_transform(x[33:64], lambda q: q * q)))"), "1")
