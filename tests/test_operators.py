"""Edge cases of the operators: shapes, special values, cycles, ambiguity, nulls."""

from __future__ import annotations

import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.functions import ieee, q15
from loomspan.functions import text as X
from loomspan.operators import attribution, census, facts, graph, retrieval, symbols
from loomspan.operators import tensor as T

NAN, INF = math.nan, math.inf


def value(spark, t):
    r = spark.range(1).select(t.alias("t")).first()["t"]
    return r["rows"], r["cols"], r["data"]


def vec(*v, rows=1):
    return T.tensor(F.array(*(F.lit(float(x)) for x in v)) if v else F.array().cast("array<double>"), rows, len(v) // rows if rows else 0)


def later(*v, rows=1):
    return lambda: vec(*v, rows=rows)  # columns need a session


GOLDEN = [
    ("OP-ADD", [later(1, 2, 3, 4, 5, 6, rows=2), later(10, 20, 30)], (2, 3, [11, 22, 33, 14, 25, 36])),
    ("OP-SUB", [later(5, 6), later(1)], (1, 2, [4, 5])),
    ("OP-DIV", [later(1, -1, 0, 4), later(0, 0, 0, 2)], (1, 4, [INF, -INF, NAN, 2])),
    ("OP-MOD", [later(-1, 1, 5.5), later(3, -3, 2)], (1, 3, [2, -2, 1.5])),
    ("OP-ROUND", [later(-2.5, 2.5, 0.4)], (1, 3, [-3, 3, 0])),
    ("OP-LOG", [later(0, -1, 1)], (1, 3, [-INF, NAN, 0])),
    ("OP-SUM", [later(1, 2, 3, 4, 5, 6, rows=2)], (1, 3, [5, 7, 9])),
    ("OP-MEAN", [later(1, 2, 6)], (1, 1, [3])),
    ("OP-MAX", [later(NAN, 1, 3, 2)], (1, 1, [3])),
    ("OP-MAX", [later(NAN, NAN)], (1, 1, [NAN])),
    ("OP-MIN", [later(2, NAN, 1)], (1, 1, [1])),
    ("OP-PROD", [later(1, 2, 3, 4, rows=2)], (1, 1, [24])),
    ("OP-ALL", [later()], (1, 1, [0])),
    ("OP-ANY", [later(0, 0, 2)], (1, 1, [1])),
    ("OP-ISINF", [later(INF, 1.79e308, -INF)], (1, 3, [1, 0, 1])),
    ("OP-ISEQUAL", [later(1, NAN), later(1, NAN)], (1, 1, [0])),
    ("OP-ISEQUAL", [later(1, 2, rows=2), later(1, 2)], (1, 1, [0])),
    ("OP-FLATTEN", [later(1, 2, 3, 4, rows=2)], (1, 4, [1, 3, 2, 4])),
    ("OP-TRANSPOSE", [later(1, 2, 3, 4, 5, 6, rows=2)], (3, 2, [1, 4, 2, 5, 3, 6])),
    ("OP-MATMUL", [later(1, 2, 3, 4, rows=2), later(5, 6, 7, 8, rows=2)], (2, 2, [19, 22, 43, 50])),
    ("OP-SETDIFF", [later(3, 1, 1, 2), later(2)], (1, 2, [1, 3])),
    ("OP-VCAT", [later(1, 2), later(3, 4)], (2, 2, [1, 2, 3, 4])),
    ("OP-HCAT", [later(1, 2), later(3)], (1, 3, [1, 2, 3])),
]


@pytest.mark.parametrize(("op", "args", "want"), GOLDEN, ids=[f"{g[0]}-{i}" for i, g in enumerate(GOLDEN)])
def test_golden(spark, op, args, want):
    rows, cols, data = value(spark, T.CATALOGUE[op](*(a() for a in args)))
    assert (rows, cols) == want[:2] and len(data) == len(want[2])
    for x, y in zip(data, want[2], strict=True):
        assert (math.isnan(x) and math.isnan(y)) or x == pytest.approx(y)


def test_positions(spark):
    a = vec(1, 2, 3, 4, 5, 6, rows=2)
    assert value(spark, T.index(a, F.lit(2)))[2] == [4.0]  # down the columns
    assert value(spark, T.colrange(a, 2, -1)) == (2, 2, [2, 3, 5, 6])
    assert value(spark, T.range_(F.lit(3), F.lit(1)))[2] == []
    assert value(spark, T.find(a, 0, 2.0, 2))[2] == [2.0, 4.0]
    assert value(spark, T.mask(vec(1, 5, 3), 1, 3.0))[2] == [5.0, 3.0]


@pytest.mark.parametrize("bad", [lambda: T.elementwise(vec(1, 2), vec(1, 2, 3), lambda x, y: x + y), lambda: T.index(vec(1), F.lit(2)), lambda: T.slice_(vec(1, 2), 1, 3), lambda: T.mod(vec(1), vec(0)), lambda: T.sum_(vec()), lambda: T.matmul(vec(1, 2), vec(1, 2)), lambda: T.fill(1.0, 0, 2)])
def test_errors(spark, bad):
    with pytest.raises(Exception, match="(?i)error|bounds|zero|shape|differ|below|nothing|broadcast"):
        value(spark, bad())


def test_lenient(spark, monkeypatch):
    monkeypatch.setattr(T, "STRICT", False)
    assert spark.range(1).select(T.index(vec(1), F.lit(2)).alias("t")).first()["t"] is None


def test_ieee_scalars(spark):
    r = spark.range(1).select(ieee.ieee_div(F.lit(0.0), F.lit(0.0)).alias("a"), ieee.ieee_log2(F.lit(0.0)).alias("b"), ieee.ieee_log10(F.lit(-1.0)).alias("c"), ieee.floored_mod(F.lit(1.0), F.lit(-3.0)).alias("d")).first()
    assert math.isnan(r["a"]) and r["b"] == -INF and math.isnan(r["c"]) and r["d"] == -2


def test_q15_against_integers(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randint(-32768, 32767), rnd.choice([1, -1]) * rnd.randint(1, 32767)) for _ in range(200)] + [(-32768, -32768), (32767, 1), (-32768, 1), (0, -5), (-3, 16384)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", q15.add(F.col("a"), F.col("b")).alias("add"), q15.sub(F.col("a"), F.col("b")).alias("sub"), q15.mul(F.col("a"), F.col("b")).alias("mul"), q15.div(F.col("a"), F.col("b")).alias("div")).collect()
    sat = lambda x: max(-32768, min(32767, x))
    for r in got:
        a, b = r["a"], r["b"]
        q = (abs(a) * 32768 + abs(b) // 2) // abs(b)
        assert (r["add"], r["sub"], r["mul"], r["div"]) == (sat(a + b), sat(a - b), sat(int((a * b + 16384) / 32768)), sat(-q if (a < 0) != (b < 0) else q))
    with pytest.raises(Exception, match="divisor"):
        df.select(q15.div(F.col("a"), F.col("b") * 0)).collect()
    r = spark.range(1).select(q15.quantise(F.lit(1.5)).alias("h"), q15.quantise(F.lit(-2.0)).alias("l"), q15.quantise(F.lit(0.5)).alias("m")).first()
    assert tuple(r) == (32767, -32768, 16384)


def edge_table(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=18))
def test_components_and_cycles(spark, pairs):
    e = edge_table(spark, pairs)
    reach = {a: {a} for p in pairs for a in p}
    for _ in range(len(reach)):
        for a, b in pairs:
            for r in reach.values():
                if a in r:
                    r.add(b)
    strong = {a: {b for b in reach[a] if a in reach[b]} for a in reach}
    got = {r["node"]: r["component"] for r in graph.strong_components(e).collect()}
    assert got == {a: max(s) for a, s in strong.items() if len(s) > 1}
    group = {a: {a} for a in reach}
    for _ in range(len(reach)):
        for a, b in pairs:
            both = group[a] | group[b]
            for x in both:
                group[x] = both
    assert {r["node"]: r["component"] for r in graph.components(e).collect()} == {a: min(g) for a, g in group.items()}


def test_closure_cap_is_undecided(spark):
    e = edge_table(spark, [(i, i + 1) for i in range(10)])
    start = spark.createDataFrame([(0,)], "node long")
    assert graph.closure(e, start)[1] == "ok" and graph.closure(e, start)[0].count() == 11
    assert graph.closure(e, start, cap=3)[1] == "undecided"
    assert graph.strong_components(edge_table(spark, [(0, 1)])).count() == 0


def test_closure_query_has_no_cap(spark, tmp_path):
    from loomspan.queries.graphs import QUERIES

    n = graph.CLOSURE_CAP + 10  # order k calls part k from part 0
    lines = spark.range(1, n).select(F.col("id").alias("l_orderkey"), F.explode(F.expr("array(named_struct('l_linenumber', 1, 'l_partkey', 0L), named_struct('l_linenumber', 2, 'l_partkey', id))")).alias("x"), F.lit(1.0).alias("l_quantity"))
    lines.select("l_orderkey", "x.*", "l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, "a", "b", "c", 1)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in QUERIES["graph_closure"](spark, str(tmp_path)).collect()] == [(n, "ok")]


def test_edges_of_many_calls_stay_small(spark, tmp_path, request):
    import pyarrow.parquet as pq

    from loomspan.queries.graphs import QUERIES

    wide = spark.conf.get("spark.sql.shuffle.partitions")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", wide))
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    n, same = 300_000, 6  # order k calls part 2k + 1 from part 2k; a name has so many parts
    lines = spark.range(n).select(F.expr("id div 2").alias("l_orderkey"), F.expr("cast(id % 2 as int)").alias("l_linenumber"), F.col("id").alias("l_partkey"), F.lit(1.0).alias("l_quantity"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(n).selectExpr("id as p_partkey", f"concat('Part', id div {same}) as p_name", "'b' as p_brand", "'t' as p_type", "1 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    QUERIES["graph_call_fanout_join"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/edges")
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "edges").glob("*.parquet")]
    callers = [m.row_group(i).column(0) for m in files for i in range(m.num_row_groups)]
    assert not any("PLAIN" in c.encodings for c in callers)  # no dictionary of callers ran over, after which each edge takes 8 bytes
    got = spark.read.parquet(f"{tmp_path}/edges").groupBy("caller").agg(F.sort_array(F.collect_list("callee")).alias("callees"), F.count_distinct("line").alias("lines"))
    want = spark.range(1, n, 2).where("id % 3 = 0 or id % 11 <> 0").select((F.col("id") - 1).alias("caller"), F.expr(f"sequence(id div {same} * {same}, least(id div {same} * {same} + {same - 1}, {n - 1}))").alias("callees"), F.lit(1).cast("long").alias("lines"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_reaching(spark):
    rnd = random.Random(9)
    pairs = [(rnd.randint(0, 39), rnd.randint(0, 39)) for _ in range(55)] + [(50, 50), (0, 0)]
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    asked = [(a, b, "x") for a in range(0, 52, 3) for b in range(52)] + [(1, 2, "y"), (1, 2, "y")]
    got = graph.reaching(edge_table(spark, pairs), spark.createDataFrame(asked, "root long, node long, name string"))
    assert got.columns == ["root", "node", "name"]
    assert sorted(map(tuple, got.collect())) == sorted(p for p in asked if p[1] in reach(p[0]))


def reached_by(pairs):
    """For each node, what it reaches, itself included."""
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = {}
    for start in {x for p in pairs for x in p}:
        seen, todo = {start}, [start]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        found[start] = seen
    return found


@pytest.mark.parametrize(("dense", "far"), [(graph.DENSE, 32), (1, 2)])
def test_changed_impact_of_cycles_and_long_chains(spark, monkeypatch, dense, far):
    monkeypatch.setattr(graph, "DENSE", dense)
    rnd = random.Random(5)
    ring = [(i, (i + 1) % 30) for i in range(30)] + [(rnd.randint(0, 29), rnd.randint(0, 29)) for _ in range(90)]
    chain = [(i, i + 1) for i in range(100, 100 + far)] + [(100 + far, 3), (7, 200), (200, 201), (201, 200), (201, 202), (300, 301), (99, 100 + far)]
    pairs = ring + chain
    reach = reached_by(pairs)
    nodes = sorted(reach) + [400]
    reach[400] = {400}
    changed = {n for n in nodes if n % 3 == 0}
    functions = spark.createDataFrame([(n, f"f{n % 3}") for n in nodes], "node long, rel string")
    tops, files = graph.changed_impact(edge_table(spark, pairs), functions, functions.where("rel = 'f0'").select("rel"))
    called = {b for _, b in pairs}
    want = {n: len(reach[n] & changed) for n in nodes if n not in called and reach[n] & changed}
    assert {r["node"]: r["affected"] for r in tops.collect()} == want and want[100] >= 10  # also what is further than 30 calls away
    hit = [n for n in nodes if reach[n] & changed]
    assert {r["rel"]: r["affected"] for r in files.collect()} == {f: sum(f"f{n % 3}" == f for n in hit) for f in ("f0", "f1", "f2")}


def test_changed_impact_keeps_no_pairs_within_cycles(spark, monkeypatch):
    sizes, real = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: (out := real(df), sizes.append(out.count()))[0])
    edges = edge_table(spark, [(i, (i * 7 + 1) % 400) for i in range(400)] + [(i, (i + 1) % 400) for i in range(400)])
    functions = spark.range(400).select(F.col("id").alias("node"), F.lit("f").alias("rel"))
    tops, files = graph.changed_impact(edges, functions, functions.select("rel"))
    assert tops.count() == 0 and [tuple(r) for r in files.collect()] == [("f", 400)]
    assert max(sizes) <= 800  # edges, and not 400 x 400 pairs


@pytest.mark.parametrize("many", [1, 40])
def test_sandwich_against_brute_force(spark, monkeypatch, many):
    """Definitions of a name beyond its roots' reach make no rows, whichever way they are fewer."""
    sizes = []
    for write in ("cut", "kept"):
        monkeypatch.setattr(graph, write, lambda df, real=getattr(graph, write): (out := real(df), sizes.append(out.count()))[0])
    rnd = random.Random(many)
    possible = [(i, (i + 1) % 12) for i in range(12)] + [(rnd.randint(12, 40), rnd.randint(0, 40)) for _ in range(40)]
    sure = possible[::2]
    defs = [(f"n{i % 4}", i) for i in range(41) for _ in range(1 + (i == 5))] + [("n1", 1000 + i) for i in range(50 * many)] + [("only", 7), ("away", 999)]
    refs = [(f"n{rnd.randint(0, 4)}", rnd.randint(0, 40)) for _ in range(60)] + [("only", 6), ("only", 6), ("only", 3), ("only", 7), ("away", 3), ("n1", 555)]
    reach = {k: reached_by([*e, *((x, x) for x in range(41)), (555, 555)]) for k, e in (("sure", sure), ("possible", possible))}

    def want(name, root):
        one, two = ([n for d, n in defs if d == name and n in reach[k][root]] for k in ("sure", "possible"))
        if len(one) == len(two) == 1 and one == two:
            return one[0], "resolved"
        return None, "undecided" if two else "unreachable"

    got = graph.sandwich(spark.createDataFrame(refs, "name string, root long"), spark.createDataFrame(defs, "name string, node long"), edge_table(spark, sure), edge_table(spark, possible))
    assert sorted((r["name"], r["root"], str(r["target"]), r["status"]) for r in got.collect()) == sorted((n, a, str(want(n, a)[0]), want(n, a)[1]) for n, a in refs)
    assert max(sizes) <= len(defs) + 1000


def test_runs_of_lines(spark):
    rnd = random.Random(4)
    base = [f"line {rnd.randint(0, 60)}" for _ in range(60)]
    docs = {0: base, 1: base[:], 2: base[10:50], 3: ["same"] * 9, 4: ["same"] * 5, 5: [], 6: base[:3]}
    docs[1][20] = docs[1][40] = "changed"
    docs[7] = base[:18] + ["x", "y"] + base[20:34] + ["z"] + base[35:]
    rows = [(d, p, x) for d, own in docs.items() for p, x in enumerate(own)]
    lines = spark.createDataFrame(rows, "doc_id long, pos long, line string")

    def blocks(a, b, least, share):
        for i in range(len(docs[a])):
            for j in range(len(docs[b])):
                eq = [x == y for x, y in zip(docs[a][i:], docs[b][j:], strict=False)]
                for n in range(least, len(eq) + 1):
                    if eq[0] and eq[n - 1] and sum(eq[:n]) >= share * n - 1e-9:
                        yield (n, sum(eq[:n]), -i, i - j)

    for share in (0.92, 0.75, 1.0):
        got = {(r["a"], r["b"]): (r["start_a"], r["start_b"], r["n"], r["same"]) for r in retrieval.similar_runs(lines, 4, share).collect()}
        want = {}
        for a in docs:
            for b in range(a + 1, len(docs)):
                if top := max(blocks(a, b, 4, share), default=None):
                    want[a, b] = (-top[2], -top[2] - top[3], top[0], top[1])
        assert got == want
    exact = sorted(tuple(r) for r in retrieval.line_runs(lines, 4).collect())
    want = []
    for a in docs:
        for b in range(a + 1, len(docs)):
            for i, x in enumerate(docs[a]):
                for j, y in enumerate(docs[b]):
                    if x == y and not (i and j and docs[a][i - 1] == docs[b][j - 1]):
                        n = next((k for k, (p, q) in enumerate(zip(docs[a][i:], docs[b][j:], strict=False)) if p != q), min(len(docs[a]) - i, len(docs[b]) - j))
                        want += [(a, b, i, j, n)] if n >= 4 else []
    assert exact == sorted(want)
    assert retrieval.similar_runs(lines.limit(0)).collect() == []


def test_ladder_never_guesses(spark):
    defs = spark.createDataFrame([("f", "a"), ("g", "a"), ("g", "b"), ("h", "a"), ("h", "a")], "name string, rel string")
    refs = spark.createDataFrame([("f", "z"), ("g", "a"), ("g", "z"), ("h", "a"), ("x", "a")], "name string, rel string")
    got = {(r["name"], r["rel"]): r["rung"] for r in graph.resolution_ladder(refs, defs).collect()}
    assert got == {("f", "z"): "unique", ("g", "a"): "same_file", ("g", "z"): "ambiguous", ("h", "a"): "ambiguous", ("x", "a"): "external"}


def test_retrieval(spark):
    docs = spark.createDataFrame([(0, "solver matrix norm"), (1, "plot figure axis"), (2, None), (3, "")], "doc_id long, text string")
    top = retrieval.bm25(docs, "matrix matrix", 3).collect()
    assert [r["doc_id"] for r in top] == [0]
    assert retrieval.bm25(docs, "absent", 3).collect() == []
    v = retrieval.hash_vectors(docs).where("doc_id = 0").collect()
    assert sum(r["v"] ** 2 for r in v) == pytest.approx(1)
    r = spark.range(1).select(X.vector_cell(F.lit("foo"))[0].alias("d"), X.vector_cell(F.lit("foo"))[1].alias("s"), X.identifier_parts(F.lit("HTTPServer_v2Name")).alias("p"), X.han_pairs(F.lit("ab 中文字 x")).alias("h")).first()
    assert (r["d"], r["s"]) == (219, -1.0) and r["p"] == ["http", "server", "v", "2", "name"] and r["h"] == ["中文", "文字"]
    pairs = retrieval.jaccard_pairs(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c")], "doc_id long, token string"), 0.9).collect()
    assert [(p["a"], p["b"], p["jaccard"]) for p in pairs] == [(1, 2, 1.0)]


def test_diffs_treat_nulls_as_values(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k long, v string")
    b = spark.createDataFrame([(1, None), (2, None), (4, "z")], "k long, v string")
    assert {r["k"]: r["status"] for r in facts.diff(a, b, ["k"], ["v"]).collect()} == {1: "unchanged", 2: "changed", 3: "removed", 4: "added"}
    alerts = spark.createDataFrame([("r", None, 1), ("r", "f", 1)], "rule string, rel string, line long")
    assert facts.suppressed(alerts, alerts.limit(1), ["rule", "rel", "line"]).count() == 1
    assert {r["rule"]: r["over"] for r in facts.gate(alerts, {"r": 1, "s": 0}).collect()} == {"r": True, "s": False}


def test_attribution(spark):
    exports = spark.createDataFrame([("f", "a.so"), ("f", "b.so"), ("g", "a.so"), ("g", "a.so")], "name string, path string")
    assert [r["name"] for r in attribution.conflicts(exports).collect()] == ["f"]
    got = {r["name"]: (r["status"], r["origins"]) for r in attribution.attribute(spark.createDataFrame([("f",), ("_g",), ("k",), ("n",)], "name string"), exports, spark.createDataFrame([("k", "gpu")], "name string, path string"), "_").collect()}
    assert got == {"f": ("library", ["a.so", "b.so"]), "_g": ("library", ["a.so"]), "k": ("kernel", ["gpu"]), "n": ("missing", [])}
    names = spark.createDataFrame([("/usr/lib/libFoo.so.1.2",), ("C:\\x\\foo-3.dll",), ("foo.1.dylib",), ("Foo.framework",)], "n string")
    assert {r[0] for r in names.select(X.library_family(F.col("n"))).collect()} == {"foo"}


def test_call_chain_over_cycles_is_null(spark):
    own = spark.createDataFrame([(1, 10), (2, 20), (3, 5), (4, 1), (5, 1)], "node long, bytes long")
    got = {r["node"]: r["total"] for r in census.call_chain_bytes(own, edge_table(spark, [(1, 2), (1, 2), (2, 3), (4, 5), (5, 4)])).collect()}
    assert got == {1: 60, 2: 25, 3: 5, 4: None, 5: None}


def test_wildcards_are_characters(spark):
    s = spark.createDataFrame([(1, 1, "a_b", "x.a_b", "function", 1), (2, 1, "axb", "x.axb", "function", 2)], "symbol_id long, file_id long, name string, dotted_name string, kind string, line long")
    f = spark.createDataFrame([(1, "p")], "file_id long, path string")
    assert [r["symbol_id"] for r in symbols.query_symbols(s, f, "A_B").collect()] == [1]


def test_search_finds_every_hit_of_a_line(spark):
    docs = [(1, "a password, secret \U0001f600 Passwd; xpass pass\nnothing\nsecret"), (2, None), (3, ""), (4, "secretsecret pass")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for rx, ids in ((r"\bpass\w*|\bsecret", (1, 2, 3, 4)), (r"s+", (1, 2, 3, 4)), (r"e*", (2, 3, 4))):
        got = sorted(map(tuple, retrieval.search_lines(df.where(F.col("doc_id").isin(*ids)), rx, regex=True).collect()))
        lines = [(d, k, x) for d, t in docs if t is not None and d in ids for k, x in enumerate(t.split("\n"), 1)]
        assert got == sorted((d, k, m.start() + 1, m.group()) for d, k, x in lines for m in re.finditer(rx, x, re.I))
