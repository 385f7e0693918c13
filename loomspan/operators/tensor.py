"""Dense arrays in columns: the catalogue of array operators on packed tensors, and long-form operators that scale out.

A packed tensor is struct<rows, cols, data>: doubles by row, a vector being one row. Every packed operator is a column
expression without a shuffle; shapes are checked first and a mismatch raises (strict) or gives null (lenient). A long tensor is
a DataFrame (i, j, v), 1-based, for matrices that don't fit a row; its operators are joins and aggregations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import ieee

STRICT = True


def tensor(data: Column, rows: Column | int = 1, cols: Column | int | None = None) -> Column:
    as_long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    cols = F.size(data) if cols is None else cols
    return F.struct(as_long(rows).alias("rows"), as_long(cols).alias("cols"), data.alias("data"))


def scalar(v: Column) -> Column:
    return tensor(F.array(v.cast("double")), 1, 1)


def checked(ok: Column, value: Column, what: str) -> Column:
    """value where ok; else an error, or null in lenient mode."""
    if not STRICT:
        return F.when(ok, value)
    # the message is evaluated only where the check fails
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def bound(op: Callable[..., Column], tensors: int = 1) -> Callable[..., Column]:
    """op with its first arguments, tensors, bound once, so that nesting operators doesn't repeat their inputs."""
    if tensors == 1:
        return lambda t, *more, **named: let(t, lambda x: op(x, *more, **named))
    return lambda a, b, *more, **named: let(F.struct(a.alias("a"), b.alias("b")), lambda p: op(p["a"], p["b"], *more, **named))


def _zeros(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def at(data: Column, i: Column) -> Column:
    return F.get(data, i.cast("int"))


def numel(t: Column) -> Column:
    return t["rows"] * t["cols"]


def _build(rows: Column, cols: Column, f: Callable[[Column, Column], Column]) -> Column:
    """A tensor of f(i, j), both from 0."""
    safe = F.greatest(cols, F.lit(1).cast("long"))
    return tensor(F.transform(_zeros(rows * cols), lambda k: f(F.floor(k / safe), k % safe)), rows, cols)


# element-wise, with broadcasting of axes of length one


def elementwise(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    rows, cols = F.greatest(a["rows"], b["rows"]), F.greatest(a["cols"], b["cols"])
    fits = ((a["rows"] == b["rows"]) | (a["rows"] == 1) | (b["rows"] == 1)) & ((a["cols"] == b["cols"]) | (a["cols"] == 1) | (b["cols"] == 1))
    same = (a["rows"] == b["rows"]) & (a["cols"] == b["cols"])

    def pick(t: Column, i: Column, j: Column) -> Column:
        return at(t["data"], F.when(t["rows"] == 1, 0).otherwise(i) * t["cols"] + F.when(t["cols"] == 1, 0).otherwise(j))

    spread = _build(rows, cols, lambda i, j: f(pick(a, i, j), pick(b, i, j)))
    return checked(fits, F.when(same, tensor(F.zip_with(a["data"], b["data"], f), rows, cols)).otherwise(spread), "shapes don't broadcast")


def unary(t: Column, f: Callable[[Column], Column]) -> Column:
    return tensor(F.transform(t["data"], f), t["rows"], t["cols"])


def _number(p: Column) -> Column:
    return F.when(p, F.lit(1.0)).otherwise(F.lit(0.0))


def mod(a: Column, b: Column) -> Column:
    fits = (a["rows"] == b["rows"]) & (a["cols"] == b["cols"])
    return checked(fits, tensor(F.zip_with(a["data"], b["data"], ieee.floored_mod), a["rows"], a["cols"]), "mod: shapes differ")


# reductions over the first axis that isn't of length one


def _reduce(t: Column, start: Callable[[Column], Column], merge: Callable[[Column, Column], Column], finish: Callable[[Column, Column], Column] = lambda s, n: s) -> Column:
    def over(n: Column, value: Callable[[Column], Column]) -> Column:
        return finish(F.aggregate(_zeros(n), start(value(F.lit(0))), lambda s, k: merge(s, value(k))), n)

    row = scalar(over(t["cols"], lambda k: at(t["data"], k)))
    by_col = tensor(F.transform(_zeros(t["cols"]), lambda j: over(t["rows"], lambda i: at(t["data"], i * t["cols"] + j))), 1, t["cols"])
    return checked(numel(t) > 0, F.when(t["rows"] > 1, by_col).otherwise(row), "a reduction of nothing")


def _better(a: Column, b: Column, least: bool) -> Column:
    """A NaN stays only if no number follows; a number never gives way to NaN."""
    wins = (b < a) if least else (b > a)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).when(wins, b).otherwise(a)


def sum_(t: Column) -> Column:
    return _reduce(t, lambda v: v * 0.0, lambda s, v: s + v)


def mean(t: Column) -> Column:
    return _reduce(t, lambda v: v * 0.0, lambda s, v: s + v, lambda s, n: s / n)


def max_(t: Column) -> Column:
    return _reduce(t, lambda v: v, lambda s, v: _better(s, v, False))


def min_(t: Column) -> Column:
    return _reduce(t, lambda v: v, lambda s, v: _better(s, v, True))


def prod(t: Column) -> Column:
    """The product of all elements."""
    return checked(numel(t) > 0, scalar(F.aggregate(t["data"], F.lit(1.0), lambda s, v: s * v)), "a product of nothing")


def any_(t: Column) -> Column:
    return scalar(_number(F.exists(t["data"], lambda v: v != 0)))


def all_(t: Column) -> Column:
    """All elements are non-zero; nothing at all is 0."""
    return scalar(_number((numel(t) > 0) & F.forall(t["data"], lambda v: v != 0)))


def nnz(t: Column) -> Column:
    return scalar(F.size(F.filter(t["data"], lambda v: v != 0)))


# shapes


def size(t: Column, dim: int) -> Column:
    value = t["rows"] if dim == 1 else t["cols"] if dim == 2 else F.when(numel(t) == 0, 0).otherwise(1)
    return scalar(value)


def size_all(t: Column) -> Column:
    return tensor(F.array(t["rows"].cast("double"), t["cols"].cast("double")))


def length(t: Column) -> Column:
    return scalar(F.when(numel(t) == 0, 0).otherwise(F.greatest(t["rows"], t["cols"])))


def isempty(t: Column) -> Column:
    return scalar(_number(numel(t) == 0))


def isequal(a: Column, b: Column) -> Column:
    """Same shape and same values; a NaN equals nothing."""
    same = (a["rows"] == b["rows"]) & (a["cols"] == b["cols"])
    pairs = F.forall(F.zip_with(a["data"], b["data"], lambda x, y: (x == y) & ~F.isnan(x)), lambda p: F.coalesce(p, F.lit(False)))
    return scalar(_number(same & pairs))


def isequalk(t: Column, k: float) -> Column:
    return scalar(_number((numel(t) == 1) & (at(t["data"], F.lit(0)) == k)))


# indexing: everything counts from one


def index(t: Column, i: Column) -> Column:
    """The element at a linear index that runs down the columns."""
    k = F.when(t["rows"] == 1, i - 1).otherwise(((i - 1) % t["rows"]) * t["cols"] + F.floor((i - 1) / F.greatest(t["rows"], F.lit(1))))
    return checked((i >= 1) & (i <= numel(t)), scalar(at(t["data"], k)), "index out of bounds")


def idx2(t: Column, i: Column, j: Column) -> Column:
    ok = (i >= 1) & (i <= t["rows"]) & (j >= 1) & (j <= t["cols"])
    return checked(ok, scalar(at(t["data"], (i - 1) * t["cols"] + j - 1)), "index out of bounds")


def _put(t: Column, k: Column, v: Column) -> Column:
    return tensor(F.transform(t["data"], lambda x, n: F.when(n == k, v.cast("double")).otherwise(x)), t["rows"], t["cols"])


def setidx(t: Column, i: Column, v: Column) -> Column:
    return checked((i >= 1) & (i <= numel(t)), _put(t, i - 1, v), "index out of bounds")


def setidx2(t: Column, i: Column, j: Column, v: Column) -> Column:
    ok = (i >= 1) & (i <= t["rows"]) & (j >= 1) & (j <= t["cols"])
    return checked(ok, _put(t, (i - 1) * t["cols"] + j - 1, v), "index out of bounds")


def row(t: Column, i: Column) -> Column:
    return checked((i >= 1) & (i <= t["rows"]), tensor(F.slice(t["data"], ((i - 1) * t["cols"] + 1).cast("int"), t["cols"].cast("int"))), "row out of bounds")


def col(t: Column, j: Column) -> Column:
    return checked((j >= 1) & (j <= t["cols"]), tensor(F.transform(_zeros(t["rows"]), lambda i: at(t["data"], i * t["cols"] + j - 1))), "column out of bounds")


def colrange(t: Column, p: int, q: int) -> Column:
    """Columns p to q; q below zero is the last."""
    high = F.lit(q).cast("long") if q >= 0 else t["cols"]
    ok = (high <= t["cols"]) & (high >= p) & F.lit(p >= 1)
    return checked(ok, _build(t["rows"], high - p + 1, lambda i, j: at(t["data"], i * t["cols"] + j + p - 1)), "columns out of bounds")


def slice_(t: Column, a: int, b: int) -> Column:
    return checked((F.lit(a) >= 1) & (F.lit(b) <= numel(t)) & (t["rows"] == 1), tensor(F.slice(t["data"], a, b - a + 1)), "slice out of bounds")


def mask(t: Column, code: int, k: float) -> Column:
    return tensor(F.filter(t["data"], lambda v: ieee.COMPARE[code](v, F.lit(k))))


def find(t: Column, code: int, k: float, most: int = 0) -> Column:
    """Places of hits in order down the columns, the first `most` if that is above 0."""
    v = flatten(t)["data"]
    hits = F.filter(F.transform(_zeros(numel(t)), lambda i: i + 1), lambda i: ieee.COMPARE[code](at(v, i - 1), F.lit(k)))
    hits = F.transform(hits, lambda i: i.cast("double"))
    return tensor(F.slice(hits, 1, most) if most > 0 else hits)


def find2(a: Column, b: Column, code: int) -> Column:
    hits = F.filter(F.transform(_zeros(numel(a)), lambda i: i + 1), lambda i: ieee.COMPARE[code](at(a["data"], i - 1), at(b["data"], i - 1)))
    return checked(numel(a) == numel(b), tensor(F.transform(hits, lambda i: i.cast("double"))), "find: sizes differ")


# building and joining


def fill(v: float, rows: Column | int, cols: Column | int) -> Column:
    rows, cols = (x if isinstance(x, Column) else F.lit(x) for x in (rows, cols))
    return checked((rows >= 1) & (cols >= 1), tensor(F.array_repeat(F.lit(float(v)), (rows * cols).cast("int")), rows, cols), "fill: a length below one")


def range_(lo: Column, hi: Column) -> Column:
    """lo to hi by ones as a column; nothing if hi is below lo."""
    n = F.greatest(hi - lo + 1, F.lit(0)).cast("long")
    return tensor(F.transform(_zeros(n), lambda k: (lo + k).cast("double")), n, F.when(n > 0, 1).otherwise(0))


def copy(t: Column) -> Column:
    return t


def hcat(a: Column, b: Column) -> Column:
    return checked((a["rows"] == 1) & (b["rows"] == 1), tensor(F.concat(a["data"], b["data"])), "hcat: vectors only")


def vcat(a: Column, b: Column) -> Column:
    return checked(a["cols"] == b["cols"], tensor(F.concat(a["data"], b["data"]), a["rows"] + b["rows"], a["cols"]), "vcat: columns differ")


def flatten(t: Column) -> Column:
    """All elements down the columns."""
    return tensor(transpose(t)["data"])


def transpose(t: Column) -> Column:
    return _build(t["cols"], t["rows"], lambda i, j: at(t["data"], j * t["cols"] + i))


def setdiff(a: Column, b: Column) -> Column:
    return checked(numel(a) > 0, tensor(F.sort_array(F.array_except(a["data"], b["data"]))), "setdiff: nothing to take from")


def matmul(a: Column, b: Column) -> Column:
    def cell(i: Column, j: Column) -> Column:
        return F.aggregate(_zeros(a["cols"]), F.lit(0.0), lambda s, k: s + at(a["data"], i * a["cols"] + k) * at(b["data"], k * b["cols"] + j))

    return checked(a["cols"] == b["rows"], _build(a["rows"], b["cols"], cell), "matmul: inner lengths differ")


# from here on all operators bind their tensors
elementwise = bound(elementwise, 2)
mod = bound(mod, 2)
isequal = bound(isequal, 2)
find2 = bound(find2, 2)
hcat = bound(hcat, 2)
vcat = bound(vcat, 2)
setdiff = bound(setdiff, 2)
matmul = bound(matmul, 2)
unary = bound(unary)
sum_ = bound(sum_)
mean = bound(mean)
max_ = bound(max_)
min_ = bound(min_)
prod = bound(prod)
all_ = bound(all_)
length = bound(length)
isempty = bound(isempty)
isequalk = bound(isequalk)
index = bound(index)
idx2 = bound(idx2)
setidx = bound(setidx)
setidx2 = bound(setidx2)
row = bound(row)
col = bound(col)
colrange = bound(colrange)
slice_ = bound(slice_)
find = bound(find)
transpose = bound(transpose)
size = bound(size)
size_all = bound(size_all)

_UNARY: dict[str, Callable[[Column], Column]] = {
    "OP-ABS": F.abs, "OP-SQRT": F.sqrt, "OP-EXP": F.exp, "OP-LOG": ieee.ieee_ln, "OP-LOG2": ieee.ieee_log2, "OP-LOG10": ieee.ieee_log10,
    "OP-SIN": F.sin, "OP-COS": F.cos, "OP-TAN": F.tan, "OP-FLOOR": lambda x: F.floor(x).cast("double"), "OP-CEIL": lambda x: F.ceil(x).cast("double"),
    "OP-ROUND": ieee.half_away, "OP-ISNAN": lambda x: _number(F.isnan(x)), "OP-ISINF": lambda x: _number(ieee.is_inf(x)),
}

#: The catalogue: operator id to a function of packed tensors (and plain parameters).
CATALOGUE: dict[str, Callable] = {
    "OP-ADD": lambda a, b: elementwise(a, b, lambda x, y: x + y),
    "OP-SUB": lambda a, b: elementwise(a, b, lambda x, y: x - y),
    "OP-MUL": lambda a, b: elementwise(a, b, lambda x, y: x * y),
    "OP-DIV": lambda a, b: elementwise(a, b, ieee.ieee_div),
    **{k: (lambda t, f=f: unary(t, f)) for k, f in _UNARY.items()},
    "OP-MOD": mod, "OP-SUM": sum_, "OP-MEAN": mean, "OP-MAX": max_, "OP-MIN": min_, "OP-PROD": prod, "OP-ANY": any_, "OP-ALL": all_, "OP-NNZ": nnz,
    "OP-ISREAL": lambda t: scalar(F.lit(1.0)), "OP-ISNUMERIC": lambda t: scalar(F.lit(1.0)),
    "OP-SIZE": size, "OP-NUMEL": lambda t: scalar(numel(t)), "OP-LENGTH": length, "OP-ISEMPTY": isempty, "OP-ISEQUAL": isequal, "OP-ISEQUALK": isequalk,
    "OP-INDEX": index, "OP-IDX2": idx2, "OP-SETIDX": setidx, "OP-SETIDX2": setidx2, "OP-ROW": row, "OP-COL": col, "OP-COLRANGE": colrange, "OP-SLICE": slice_,
    "OP-MASK": mask, "OP-FIND": find, "OP-FIND2": find2, "OP-FIND3": find, "OP-FILLA": fill, "OP-RANGE": range_, "OP-COPY": copy, "OP-HCAT": hcat, "OP-VCAT": vcat,
    "OP-FLATTEN": flatten, "OP-TRANSPOSE": transpose, "OP-SETDIFF": setdiff, "OP-MATMUL": matmul,
}


# long form


def long_matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of the product: one join on the inner index and one aggregation."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def long_transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def long_reduce(a: DataFrame, how: Callable[[Column], Column]) -> DataFrame:
    """A value for each column j."""
    return a.groupBy("j").agg(how(F.col("v")).alias("v"))


def long_elementwise(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], on: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """Joined on the axes that b has; axes it lacks are repeated."""
    right = b.select(*on, F.col("v").alias("y"))
    return a.join(right, list(on)).select("i", "j", f(F.col("v"), F.col("y")).alias("v"))


def long_vcat(a: DataFrame, b: DataFrame, rows_of_a: Column | int) -> DataFrame:
    return a.select("i", "j", "v").unionByName(b.select((F.col("i") + rows_of_a).alias("i"), "j", "v"))


def numbered(df: DataFrame, key: str, name: str = "i") -> DataFrame:
    """Adds consecutive numbers in key order from range-partitioned counts, so no task sees all rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the part of a row follows from the key alone, so both uses of it agree whatever is computed again
    cuts = df.select(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    part = F.lit(0)
    for c in sorted(set(cuts or [])):
        part = part + (F.col(key) > F.lit(c)).cast("int")
    df = df.withColumn("__part", part)
    before = df.groupBy("__part").count().withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = Window.partitionBy("__part").orderBy(key)
    return df.withColumn("__n", F.row_number().over(own)).join(F.broadcast(before), "__part").withColumn(name, F.col("__n") + F.col("__before")).drop("__part", "__n", "__before")  # a row for each part
