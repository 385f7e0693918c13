"""Call-graph analytics over edge tables (src, dst): resolution, degrees, closures, components, bounded projections.

Ambiguous, missing and truncated are outcomes of their own: functions return a status column, or totals beside what is shown,
and never pick one of many. Iterations run as joins; each round's frontier is written to the checkpoint folder, so plans stay short and
lost executors cost one round.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed bounds of the projections.
TOP_N, MAX_CYCLES, MAX_NODES, FOCUS_DEPTH, IMPACT_DEPTH, CLOSURE_CAP = 30, 20, 300, 2, 30, 65536


#: Edges a node above which a graph is folded along a few edges of each node first.
DENSE = 8
#: Rounds of a closure that are kept side by side before they become one table.
SIDE = 8


def _folder(df: DataFrame) -> str:
    """The checkpoint folder, which is set on a cluster; a folder of our own otherwise."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="loomspan-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the checkpoint folder."""
    _folder(df)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df with its lineage cut, as a compressed table in the checkpoint folder that dropped() takes away.

    Shuffle files of jobs that have ended go when the JVM collects their plans, which a round asks for.
    """
    path = f"{_folder(df)}/loomspan/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what kept() wrote; nothing that is read later may be made of it."""
    for t in tables:
        path, sc = t.__dict__.pop("_kept_at", None), t.sparkSession.sparkContext
        if path:
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def resolve(sites: DataFrame, defs: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Call sites (caller, callee, line) to definitions (name, fkey): an edge for each match of the lower-cased name, and what matched nothing.

    tasks: among how many the calls are dealt by name. Edges can be many times the calls; where a task has few calls, its callers fit
    a Parquet dictionary, and the edges of a call take a few bytes.
    """
    keyed = sites.withColumn("lname", F.lower("callee"))
    names = defs.select(F.lower("name").alias("lname"), F.col("fkey").alias("target"))
    dealt = keyed if tasks is None else keyed.repartition(tasks, "lname")
    edges = dealt.join(names, "lname").select("caller", F.col("target").alias("callee"), "line")
    missing = keyed.join(names.select("lname").distinct(), "lname", "left_anti").select("callee", "line")
    return edges, missing


def resolution_ladder(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """refs (name, rel, ...) with the rung on which a name resolves: exactly one hit, else the next rung, never one of many.

    unique: one definition anywhere; same_file: one in the reference's own file; ambiguous: several and none singled out;
    external: none. Definitions (name, rel) are counted by name and by (name, rel) first, so the joins have one match each.
    """
    by_name = defs.groupBy("name").agg(F.count("*").alias("n_def"))
    by_file = defs.groupBy("name", "rel").agg(F.count("*").alias("n_same"))
    joined = refs.join(by_name, "name", "left").join(by_file, ["name", "rel"], "left")
    rung = F.when(F.col("n_def").isNull(), "external").when(F.col("n_def") == 1, "unique").when(F.col("n_same") == 1, "same_file").otherwise("ambiguous")
    return joined.withColumn("rung", rung).drop("n_def", "n_same")


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out; zero where a node has no edge on that side."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def top(df: DataFrame, value: str, n: int = TOP_N, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(value), *ties).limit(n)


def with_total(df: DataFrame, shown: DataFrame) -> DataFrame:
    """shown with the number of rows that it was cut from."""
    return shown.withColumn("total", F.lit(df.count()))


def distances(edges: DataFrame, starts: DataFrame, depth: int, reverse: bool = False, cap: int | None = None) -> tuple[DataFrame, bool]:
    """node and its least distance from starts (node) within depth; and whether the cap was passed (then nothing is to be concluded)."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = kept(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    seen = cut(starts.select("node").distinct().withColumn("level", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        found = frontier.join(steps, "node").select(F.col("next").alias("node")).distinct()
        frontier = cut(found.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        n = frontier.count()
        if not n:
            break
        seen = seen.unionByName(frontier)
        if level % 5 == 0:
            seen = cut(seen)
        if cap is not None and seen.count() > cap:
            dropped(steps)
            return seen, True
    dropped(steps)
    return seen, False


def closure(edges: DataFrame, starts: DataFrame, cap: int | None = CLOSURE_CAP) -> tuple[DataFrame, str]:
    """All that starts reach, themselves included, and "ok"; or "undecided" where that is more than cap (None: no cap)."""
    seen, over = distances(edges, starts, 1 << 20, cap=cap)
    return seen, "undecided" if over else "ok"


def entries(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that nothing calls."""
    return nodes.select("node").distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def trace_status(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and status: "entry" (nothing else calls it), "traced" (some entry reaches it), "orphaned" (callers, but none that an
    entry reaches: a cycle and what hangs on it)."""
    real = edges.where("src <> dst").select("src", "dst").distinct()
    known = nodes.select("node").distinct()
    tops = entries(real, known)
    reached, _ = distances(real, tops, 1 << 20)
    level = reached.select("node", "level")
    status = F.when(F.col("level") == 0, "entry").when(F.col("level") > 0, "traced").otherwise("orphaned")
    return known.join(level, "node", "left").select("node", status.alias("status"))


def chains(edges: DataFrame, start: Column, length: int, reverse: bool = True) -> DataFrame:
    """Paths without repeats from one start against the edges' direction, of 2 to `length` nodes."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    path = edges.sparkSession.range(1).select(F.array(start).alias("path"))
    out = None
    for _ in range(length - 1):
        path = cut(path.withColumn("node", F.element_at("path", -1)).join(steps, "node").where(~F.array_contains("path", F.col("next"))).select(F.concat("path", F.array("next")).alias("path")))
        out = path if out is None else out.unionByName(path)
        if path.isEmpty():
            break
    return out


def trim(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without an edge in or out are taken away again and again: what can lie on cycles."""
    edges = kept(edges.where("src <> dst").select("src", "dst").distinct())
    n = edges.count()
    while n:
        inner = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node")
        rest = kept(edges.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        dropped(edges)
        edges = rest
        if (now := edges.count()) == n:
            break
        n = now
    return edges


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node of its connected component, directions ignored: large-star and small-star rounds."""
    state = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    sign = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(state)
    while before[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        state = cut(large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        if (now := sign(state)) == before:
            break
        before = now
    members = state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    loops = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return loops.join(members, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _propagate(edges: DataFrame, colour: DataFrame, a: str, b: str) -> DataFrame:
    """The largest colour that reaches each node along edges a to b."""
    while True:
        pushed = edges.join(colour.select(F.col("node").alias(a), "colour"), a).groupBy(F.col(b).alias("node")).agg(F.max("colour").alias("came"))
        both = kept(colour.select("node", "colour").join(pushed, "node", "left").select("node", F.greatest("colour", F.coalesce("came", "colour")).alias("colour"), (F.col("came") > F.col("colour")).alias("moved")))
        dropped(colour)
        colour = both
        if both.where("moved").isEmpty():
            return colour


def _coloured(edges: DataFrame) -> DataFrame:
    """node and component (its largest node) of strongly connected components of two nodes or more.

    Forward colouring: each node takes the largest node that reaches it; what reaches back to a colour's root within
    the colour is that root's component. Found components go, and the rest is trimmed and coloured again.
    """
    edges = trim(edges)
    done: list[DataFrame] = []
    while not edges.isEmpty():
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        colour = _propagate(edges, nodes.withColumn("colour", F.col("node")), "src", "dst")
        c1 = colour.select(F.col("node").alias("src"), F.col("colour").alias("cs"))
        c2 = colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd"))
        inside = kept(edges.join(c1, "src").join(c2, "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("colour")))
        rounds = [kept(colour.where("node = colour").select("node", "colour"))]
        back = frontier = rounds[0]
        while True:
            found = inside.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
            frontier = kept(found.join(back, "node", "left_anti"))
            rounds.append(frontier)
            if frontier.isEmpty():
                break
            back = back.unionByName(frontier)
            if len(rounds) > SIDE:
                back = kept(back)
                dropped(*rounds[:-1])
                rounds = [back, frontier]
        many = back.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
        done.append(kept(back.join(many, "colour").select("node", F.col("colour").alias("component"))))
        gone = back.select("node")
        rest = trim(edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
        dropped(edges, colour, inside, *rounds)
        edges = rest
        if len(done) > SIDE:
            both = kept(reduce(DataFrame.unionByName, done))
            dropped(*done)
            done = [both]
    return reduce(DataFrame.unionByName, done) if done else edges.select(F.col("src").alias("node"), F.col("src").alias("component"))


def placed(df: DataFrame, strong: DataFrame, col: str, to: str) -> DataFrame:
    """df with a column `to`: the component (strong: node, component) of the node in col, or else the node itself."""
    named = strong.select(F.col("node").alias(col), F.col("component").alias(to))
    return df.join(named, col, "left").withColumn(to, F.coalesce(to, col))


def _few(edges: DataFrame) -> DataFrame:
    """At most two edges out of and two into each node."""
    ends = lambda a, b: edges.groupBy(a).agg(F.min(b).alias("low"), F.max(b).alias("high")).select(a, F.explode(F.array("low", "high")).alias(b)).select("src", "dst")
    return ends("src", "dst").unionByName(ends("dst", "src")).distinct()


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node and component (its largest node) of strong components of two nodes or more; and the distinct edges (src, dst) between
    components, single nodes among them, which have no cycles.

    Of a dense graph, the components along a few edges of each node are folded first. Folding loses no path, and what is left
    is small where these few already hold most of it together, so that many edges are only read a few times.
    """
    edges = kept(edges.where("src <> dst").select("src", "dst"))
    n, parts = edges.count(), []

    def fold(strong: DataFrame) -> DataFrame:
        between = placed(placed(edges, strong, "src", "a"), strong, "dst", "b").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
        out = kept(between)
        dropped(edges)
        parts.append(strong)
        return out

    while n:
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).agg(F.approx_count_distinct("node")).first()[0]  # only chooses the way
        before = n
        if n > DENSE * nodes:
            edges = fold(_coloured(_few(edges)))
            n = edges.count()
        if not before > 2 * n:
            edges = fold(_coloured(edges))
            break
    strong = parts[0] if parts else kept(edges.select(F.col("src").alias("node"), F.col("src").alias("component")))  # no edges
    for later in parts[1:]:
        moved = later.select(F.col("node").alias("component"), F.col("component").alias("last"))
        both = strong.join(moved, "component", "left").select("node", F.coalesce("last", "component").alias("component"))
        strong = both.unionByName(later.join(strong.select("node"), "node", "left_anti"))
    if len(parts) > 1:
        strong = kept(strong)
        dropped(*parts)
    return strong, edges


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (its largest node) of strongly connected components of two nodes or more."""
    strong, between = condensed(edges)
    dropped(between)
    return strong


def cycles(strong: DataFrame, most: int = MAX_CYCLES) -> DataFrame:
    """Components by size, the largest first, then by smallest member."""
    return strong.groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("first_node")).orderBy(F.desc("size"), "first_node").limit(most).select("size", "first_node")


def classify(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts of edges by class, every class present: internal, cross (files differ), ambiguous (several definitions), unknown (none)."""
    named = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("rel").alias("rel"))
    src = named.select(F.col("node").alias("src"), F.col("rel").alias("srel"))
    dst = named.select(F.col("node").alias("dst"), F.col("rel").alias("drel"), "n")
    kind = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").when(F.col("srel") == F.col("drel"), "internal").otherwise("cross")
    found = edges.join(src, "src", "left").join(dst, "dst", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    kinds = edges.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("internal", "cross", "ambiguous", "unknown")))).alias("kind"))
    return kinds.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def hub(edges: DataFrame, n: int = TOP_N) -> DataFrame:
    """The node of the greatest 2 fan_in + fan_out over the two top lists; nodes that call come first, then by name."""
    d = degrees(edges)
    ins, outs = top(d.where("fan_in > 0"), "fan_in", n, "node").select("node", "fan_in"), top(d.where("fan_out > 0"), "fan_out", n, "node").select("node", "fan_out")
    both = ins.join(outs, "node", "full_outer").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    return both.withColumn("score", 2 * F.col("fan_in") + F.col("fan_out")).orderBy(F.desc(F.col("fan_out") > 0), F.desc("score"), "node").limit(1)


def risk(metrics: DataFrame) -> DataFrame:
    """metrics (impact, fan_in, fan_out, dependency, complexity) with risk and tag."""
    i, fi, fo, cx = (F.col(c) for c in ("impact", "fan_in", "fan_out", "complexity"))
    tag = F.when((i >= 5) | (fi >= 5), "key").when((fo >= 8) | ((fo >= 5) & (cx >= 10)), "god").when((fi == 0) & (fo == 0), "isolated").otherwise("plain")
    return metrics.withColumns({"risk": 3 * i + 2 * fi + F.col("dependency") + fo + cx, "tag": tag})


def rolled_up(df: DataFrame, path: str, *values: str) -> DataFrame:
    """Sums of values over each folder and all below it: a row for each prefix of the path."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return df.withColumn("prefix", F.explode(prefixes)).groupBy("prefix").agg(F.count("*").alias("n"), *(F.sum(v).alias(v) for v in values))


def chunked(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """Rows of a group in pieces of at most `most`."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / most))


def focus(edges: DataFrame, nodes: DataFrame, name: str, depth: int = FOCUS_DEPTH, max_nodes: int = MAX_NODES, max_edges: int | None = None, direction: str = "both") -> tuple[DataFrame, DataFrame, dict]:
    """The neighbourhood of the node (node, name) that a name means: nodes (node, level), edges (src, dst), and totals.

    Of several nodes of that name (case aside) or key, that of the greatest degree is taken and the number of candidates is
    reported. Nodes are kept by level and then key, edges by key; totals say what was there before the caps.
    """
    q = name.lower()
    cand = nodes.where((F.lower("name") == q) | (F.lower(F.col("node").cast("string")) == q)).select("node").distinct()
    d = degrees(edges).select("node", (F.col("fan_in") + F.col("fan_out")).alias("degree"))
    info: dict = {"candidates": cand.count()}
    start = cand.join(d, "node", "left").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "node").limit(1).select("node")
    plain = edges.select("src", "dst")
    flow = {"callee": plain, "caller": plain.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "both": plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst")))}[direction]
    found, _ = distances(flow, start, depth)
    found = cut(found)
    kept = cut(found.orderBy("level", "node").limit(max_nodes))
    inner = plain.distinct().join(kept.select(F.col("node").alias("src")), "src").join(kept.select(F.col("node").alias("dst")), "dst").select("src", "dst")
    info |= {"nodes_total": found.count(), "edges_total": inner.count()}
    shown = inner.orderBy("src", "dst").limit(max_edges) if max_edges is not None else inner
    info |= {"nodes_shown": min(max_nodes, info["nodes_total"]), "edges_shown": min(max_edges or info["edges_total"], info["edges_total"])}
    return kept, shown, info | {"truncated": info["nodes_shown"] < info["nodes_total"] or info["edges_shown"] < info["edges_total"]}


def call_relations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """section, key, n: totals, edges by class, and the top callees and callers, in one table."""
    d = degrees(edges)
    row = lambda df, section, key, n: df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.col(n).cast("long").alias("n"))
    totals = d.agg(F.count("*").alias("nodes"), F.sum("fan_out").alias("edges")).select(F.expr("stack(2, 'nodes', nodes, 'edges', edges) as (key, n)"))
    return (
        row(totals, "total", "key", "n")
        .unionByName(row(classify(edges, nodes), "class", "kind", "n"))
        .unionByName(row(top(d.where("fan_in > 0"), "fan_in", TOP_N, "node"), "fan_in", "node", "fan_in"))
        .unionByName(row(top(d.where("fan_out > 0"), "fan_out", TOP_N, "node"), "fan_out", "node", "fan_out"))
    )


def reachable_pairs(edges: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """root and node for all that each root (node) reaches within depth, itself included."""
    steps = kept(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    rounds = [kept(roots.select(F.col("node").alias("root"), "node").distinct())]
    seen = frontier = rounds[0]
    for _ in range(depth):
        found = frontier.join(steps, "node").select("root", F.col("next").alias("node")).distinct()
        frontier = kept(found.join(seen, ["root", "node"], "left_anti"))
        rounds.append(frontier)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if len(rounds) > SIDE:
            seen = kept(seen)
            dropped(*rounds[:-1])
            rounds = [seen, frontier]
    dropped(steps)
    return seen


def reaching(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (root, node, ...) whose root reaches the node.

    Strong components become single nodes first, so that a closure is only made over what is left of the graph, and only
    of components that pairs ask about; within one, all reach all.
    """
    strong, folded = condensed(edges)
    asked = cut(placed(placed(pairs, strong, "root", "__a"), strong, "node", "__b"))
    found = reachable_pairs(folded, asked.where("__a <> __b").select(F.col("__a").alias("node")), depth=1 << 20)
    hit = found.select(F.col("root").alias("__a"), F.col("node").alias("__b"))
    return asked.where("__a = __b").unionByName(asked.where("__a <> __b").join(hit, ["__a", "__b"], "left_semi").select(asked.columns)).select(pairs.columns)


def _reached_names(edges: DataFrame, refs: DataFrame, defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """strong (node, component) of edges; and part, name, n and one for the definitions (name, node) of a name that a part of the
    graph reaches, for all (part, name) that refs (name, root) ask about: their number and the smallest.

    Roots and definitions are counted by component before they meet: along reachable pairs, or along names where that makes fewer rows.
    """
    strong, folded = condensed(edges)
    asked = kept(placed(refs, strong, "root", "part").where(F.col("part").isNotNull()).select("part", "name").distinct())
    at = kept(placed(defs, strong, "node", "to").groupBy("to", "name").agg(F.count("*").alias("n"), F.min("node").alias("one")))
    pairs = kept(reachable_pairs(folded, asked.select(F.col("part").alias("node")), 1 << 20).select(F.col("root").alias("part"), F.col("node").alias("to")))

    def rows(left: DataFrame, key: str) -> float:
        own = [d.groupBy(key).agg(F.count("*").cast("double").alias(c)) for d, c in ((left, "a"), (at, "b"))]
        return own[0].join(own[1], key).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0

    if rows(pairs, "to") <= rows(asked, "name"):
        met = pairs.join(at, "to").join(asked, ["part", "name"], "left_semi")
    else:
        met = asked.join(at, "name").join(pairs, ["part", "to"], "left_semi")
    got = kept(met.groupBy("part", "name").agg(F.sum("n").alias("n"), F.min("one").alias("one")))
    dropped(folded, asked, at, pairs)
    return strong, got


def sandwich(refs: DataFrame, defs: DataFrame, sure: DataFrame, possible: DataFrame) -> DataFrame:
    """refs (name, root) with the definition (name, node) that is the only one reachable from root both over sure edges and over
    all possible edges; where the two don't agree on one, the target is null and status says why."""
    out = refs = kept(refs.select("name", "root"))
    for edges, tag in ((sure, "sure"), (possible, "possible")):
        strong, got = _reached_names(edges, refs, defs)
        named = got.select("part", "name", F.col("n").alias(f"n_{tag}"), F.col("one").alias(f"one_{tag}"))
        out = placed(out, strong, "root", "part").join(named, ["part", "name"], "left").drop("part")
    agreed = (F.col("n_sure") == 1) & (F.col("n_possible") == 1) & (F.col("one_sure") == F.col("one_possible"))
    status = F.when(agreed, "resolved").when(F.col("n_possible").isNull(), "unreachable").otherwise("undecided")
    return out.select("name", "root", F.when(agreed, F.col("one_sure")).alias("target"), F.coalesce(status, F.lit("undecided")).alias("status"))


def changed_impact(edges: DataFrame, functions: DataFrame, changed: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What a set of changed files (rel) reaches backwards: entries (node, affected) by how many changed functions lead to
    them, and files (rel, affected). functions: node, rel. Without a depth, strong components become single nodes first, each
    with the number of its changed functions, and all is reached."""
    starts = functions.join(changed.select("rel").distinct(), "rel").select("node")
    turned = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if depth is None:
        strong, folded = condensed(edges)
        weight = kept(placed(starts.distinct(), strong, "node", "root").groupBy("root").agg(F.count("*").alias("n")))
        pairs = reachable_pairs(turned(folded), weight.select(F.col("root").alias("node")), 1 << 20)
        by_part = pairs.join(weight, "root").groupBy(F.col("node").alias("component")).agg(F.sum("n").alias("affected"))
        members = by_part.join(strong, "component", "left").select(F.coalesce("node", "component").alias("node"), "affected")
        by_node = kept(members)
    else:
        by_node = reachable_pairs(turned(edges), starts, depth).groupBy("node").agg(F.countDistinct("root").alias("affected"))
    tops = entries(edges, by_node).join(by_node, "node").orderBy(F.desc("affected"), "node")
    return tops, by_node.join(functions, "node").groupBy("rel").agg(F.countDistinct("node").alias("affected")).orderBy(F.desc("affected"), "rel")
