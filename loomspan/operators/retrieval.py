"""Retrieval over documents (doc_id, text): token statistics, scores, hashed vectors, name fragments, set similarity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as X

K1, B = 1.5, 0.75


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, token, tf, and dl (tokens of the document)."""
    tokens = docs.select("doc_id", X.words(F.col(text)).alias("w"))
    return tokens.select("doc_id", F.size("w").cast("long").alias("dl"), F.explode("w").alias("token")).groupBy("doc_id", "dl", "token").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, k: int, log_idf: bool = False) -> DataFrame:
    """The k best documents. idf is max(0, (N - n + 0.5) / (n + 0.5)), without a logarithm unless log_idf; a term that the
    query has q times counts q * q. Only tokens of the question leave a document's row."""
    spark = docs.sparkSession
    asked = spark.range(1).select(X.words(F.lit(query)).alias("w")).first()["w"]
    if not asked:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    own = docs.select("doc_id", X.words(F.col("text")).alias("w"))
    lengths = own.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl")).first()
    terms = F.array(*map(F.lit, sorted(set(asked))))
    hits = own.select("doc_id", F.size("w").cast("long").alias("dl"), F.explode(F.filter("w", lambda t: F.array_contains(terms, t))).alias("token"))
    hits = hits.groupBy("doc_id", "dl", "token").agg(F.count("*").alias("tf"))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "token")  # a row a term
    qf = F.create_map(*(F.lit(x) for t in sorted(set(asked)) for x in (t, asked.count(t) ** 2)))[F.col("token")]
    ratio = (F.lit(lengths["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.ln(1 + ratio) if log_idf else F.greatest(F.lit(0.0), ratio)
    part = qf * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(lengths["avgdl"] or 1.0)))
    return scored.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


def hash_vectors(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, dim, v: the documents' hashed vectors in long form, of length one. Signs add up by dimension before the shuffle,
    so that a document sends VECTOR rows at most and no words."""
    dim, sign = X.vector_cell(F.col("token"))
    tokens = docs.select("doc_id", F.explode(X.words(F.col(text))).alias("token"))
    cells = tokens.select("doc_id", dim.alias("dim"), sign.alias("s")).groupBy("doc_id", "dim").agg(F.sum("s").alias("v")).where("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("doc_id")))
    return cells.select("doc_id", "dim", (F.col("v") / norm).alias("v"))


def vector_query(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k documents of the greatest positive inner product with each query (qid, dim, q)."""
    hits = vectors.join(query, "dim").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("v") * F.col("q")), 6).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def field_overlap(entries: DataFrame, query: str, weights: dict[str, float], key: str) -> DataFrame:
    """Sum over fields of weight * common tokens / root of the field's tokens, each token once."""
    q = F.array_distinct(X.words(F.lit(query)))
    total = F.lit(0.0)
    for name, w in weights.items():
        own = F.array_distinct(X.words(F.col(name)))
        total = total + F.when(F.size(own) > 0, F.lit(w) * F.size(F.array_intersect(own, q)) / F.sqrt(F.size(own))).otherwise(0.0)
    return entries.select(key, F.round(total, 6).alias("score")).where("score > 0")


def fragments(names: DataFrame, key: str, name: str) -> DataFrame:
    """key and fragment: the parts of identifiers, each once."""
    return names.select(key, F.explode(F.array_distinct(X.identifier_parts(F.col(name)))).alias("fragment"))


def by_fragments(frags: DataFrame, key: str, tokens: list[str]) -> DataFrame:
    """Keys in which every token begins some fragment."""
    match = F.filter(F.array(*map(F.lit, tokens)), lambda t: F.startswith(F.col("fragment"), t))
    hits = frags.select(key, F.explode(match).alias("token"))
    return hits.groupBy(key).agg(F.countDistinct("token").alias("n")).where(F.col("n") == len(set(tokens))).select(key)


def find_subject(names: DataFrame, question: str, name: str = "name") -> DataFrame:
    """The longest known name that stands in the question as a word (lower-cased); no row if there is none."""
    q = F.lit(f" {question.lower()} ")
    edge = lambda c: ~c.rlike(r"[\p{L}\p{N}_]")
    at = F.position(F.lower(F.col(name)), q)
    found = names.select(name).distinct().withColumn("__at", at).where("__at > 0")
    found = found.where(edge(F.substring(q, F.col("__at") - 1, F.lit(1))) & edge(F.substring(q, F.col("__at") + F.length(name), F.lit(1))))
    return found.select(name).orderBy(F.desc(F.length(name)), name).limit(1)


def jaccard_pairs(sets: DataFrame, least: float, key: str = "doc_id", item: str = "token") -> DataFrame:
    """Pairs of keys (a < b) whose sets of items (key, item, without repeats) have at least that Jaccard similarity.

    Only items among a set's rarest n - ceil(least * n) + 1 are joined: two sets that are similar enough share one of them
    (prefix filter), and sizes must agree to the factor least. Candidates are then compared whole.
    """
    df = sets.groupBy(item).agg(F.count("*").alias("df"))
    ranked = sets.join(df, item)
    w = Window.partitionBy(key)
    ranked = ranked.withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy("df", item))})
    prefix = ranked.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1) & (F.col("df") > 1)).select(F.col(key), item, "n")
    a, b = prefix.select(F.col(key).alias("a"), item, F.col("n").alias("na")), prefix.select(F.col(key).alias("b"), item, F.col("n").alias("nb"))
    cand = a.join(b, item).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))).select("a", "b", "na", "nb").distinct()
    left, right = sets.select(F.col(key).alias("a"), item), sets.select(F.col(key).alias("b"), F.col(item).alias("__item"))
    both = cand.join(left, "a").join(right, (cand["b"] == right["b"]) & (F.col(item) == F.col("__item"))).groupBy("a", cand["b"], "na", "nb").agg(F.count("*").alias("common"))
    j = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return both.where(j >= least).select("a", "b", F.round(j, 6).alias("jaccard"))


def line_grams(lines: DataFrame, n: int) -> DataFrame:
    """doc_id, pos and two hashes k1, k2 of each n lines (doc_id, pos, line) at positions that follow one another."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    gram = F.collect_list("line").over(w.rowsBetween(0, n - 1))
    last = F.last("pos").over(w.rowsBetween(0, n - 1))
    grams = lines.select("doc_id", "pos", gram.alias("gram"), last.alias("last")).where((F.size("gram") == n) & (F.col("last") - F.col("pos") == n - 1))
    return grams.select("doc_id", "pos", F.xxhash64("gram").alias("k1"), F.xxhash64(F.lit(1), "gram").alias("k2"))


def _meetings(lines: DataFrame, n: int) -> DataFrame:
    """a, b (a < b), pa, pb where two documents have n equal lines from there on: frequent single lines make no pairs."""
    g = line_grams(lines, n)
    a, b = (g.select(F.col("doc_id").alias(d), F.col("pos").alias(f"p{d}"), "k1", "k2") for d in ("a", "b"))
    return a.join(b, ["k1", "k2"]).where("a < b").select("a", "b", "pa", "pb", (F.col("pa") - F.col("pb")).alias("diagonal"))


def _islands(same: DataFrame) -> DataFrame:
    """Runs of consecutive pa on a diagonal: a, b, diagonal, start_a, n."""
    rank = F.row_number().over(Window.partitionBy("a", "b", "diagonal").orderBy("pa"))
    return same.withColumn("island", F.col("pa") - rank).groupBy("a", "b", "diagonal", "island").agg(F.min("pa").alias("start_a"), F.count("*").alias("n")).drop("island")


def line_runs(lines: DataFrame, least: int) -> DataFrame:
    """Runs of at least so many equal consecutive lines of two documents: lines (doc_id, pos, line) -> a, b, start_a, start_b, n."""
    found = _islands(_meetings(lines, least))
    return found.select("a", "b", "start_a", (F.col("start_a") - F.col("diagonal")).alias("start_b"), (F.col("n") + least - 1).alias("n"))


def similar_runs(lines: DataFrame, least: int = 4, share: float = 0.92) -> DataFrame:
    """For each two documents the longest block of `least` lines or more, begun and ended by equal lines, of which that share is
    equal line by line; then that of the most equal lines, and the first: a, b, start_a, start_b, n, same.

    Lines (doc_id, pos, line) have positions without holes. Of a block with x unequal lines, x / (1 - share) or more in all, some
    run of equal lines has at least as many as where x is 1, so runs of that many or of `least` show each diagonal that counts.
    """
    seed = least if share >= 1 else max(1, min(least, math.ceil((math.ceil(1 / (1 - share)) - 1) / 2)))
    near = _meetings(lines, seed).select("a", "b", "diagonal").distinct()
    own = lines.select(F.col("doc_id").alias("a"), F.col("pos").alias("pa"), F.col("line").alias("la"))
    other = lines.select(F.col("doc_id").alias("b"), F.col("pos").alias("pb"), F.col("line").alias("lb"))
    same = near.join(own, "a").withColumn("pb", F.col("pa") - F.col("diagonal")).join(other, ["b", "pb"]).where("la = lb").select("a", "b", "diagonal", "pa")
    w = Window.partitionBy("a", "b", "diagonal").orderBy("start_a")
    runs = _islands(same).withColumn("upto", F.sum("n").over(w))
    first = runs.select("a", "b", "diagonal", "start_a", (F.col("upto") - F.col("n")).alias("before"))
    last = runs.select("a", "b", "diagonal", (F.col("start_a") + F.col("n")).alias("end_a"), "upto")
    block = first.join(last, ["a", "b", "diagonal"]).select("a", "b", "diagonal", "start_a", (F.col("end_a") - F.col("start_a")).alias("n"), (F.col("upto") - F.col("before")).alias("same"))
    block = block.where((F.col("n") >= least) & (F.col("same") >= share * F.col("n") - 1e-9))
    best = block.groupBy("a", "b").agg(F.max(F.struct("n", "same", (-F.col("start_a")).alias("from_a"), "diagonal")).alias("x"))
    start = -F.col("x.from_a")
    return best.select("a", "b", start.alias("start_a"), (start - F.col("x.diagonal")).alias("start_b"), F.col("x.n").alias("n"), F.col("x.same").alias("same"))


def search_lines(docs: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = True) -> DataFrame:
    """doc_id, line, col (in characters), match of every hit in the lines of the texts (1-based).

    A pattern that matches nothing at all also hits inside characters of two UTF-16 units, as Java's does."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    body = pattern if regex else "\\Q" + pattern + "\\E"
    rx = ("(?iU)" if ignore_case else "(?U)") + body  # words and cases of all scripts
    hit = lines.where(F.col("content").rlike(rx)).withColumns({"found": F.regexp_extract_all("content", F.lit(rx), F.lit(0)), "between": F.split("content", rx, -1)})
    # an empty hit at a line's start has no piece before it
    before = F.when(F.size("between") <= F.size("found"), F.concat(F.array(F.lit("")), "between")).otherwise(F.col("between"))
    step = F.zip_with(F.slice(before, 1, F.size("found")), "found", lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("long"), m.alias("match")))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<col:int,match:string>>").alias("hits"))
    placed = F.aggregate(
        step,
        start,
        lambda a, x: F.struct((a["at"] + x["gap"] + x["long"]).alias("at"), F.concat(a["hits"], F.array(F.struct((a["at"] + x["gap"]).alias("col"), x["match"].alias("match")))).alias("hits")),
        lambda a: a["hits"],
    )
    return hit.select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), F.explode(placed).alias("hit")).select("doc_id", "line", F.col("hit.col").cast("long").alias("col"), "hit.match")


def normalised_code(line: Column) -> Column:
    """A source line with strings, numbers and spacing made alike, and the two operands of a sum or product in order."""
    x = F.regexp_replace(line, r"\"[^\"]*\"|'[^']*'", "S")
    x = F.regexp_replace(F.regexp_replace(x, r"\b[0-9]+(\.[0-9]+)?\b", "N"), r"\s+", "")
    form = r"^(.*=)?([A-Za-z_][A-Za-z0-9_]*|N|S)([+*])([A-Za-z_][A-Za-z0-9_]*|N|S)(;?)$"
    a, b = F.regexp_extract(x, form, 2), F.regexp_extract(x, form, 4)
    ordered = F.concat(F.regexp_extract(x, form, 1), F.least(a, b), F.regexp_extract(x, form, 3), F.greatest(a, b), F.regexp_extract(x, form, 5))
    return F.when(x.rlike(form), ordered).otherwise(x)


def cross_language_score(skeleton: Column, tokens: Column, run: Column) -> Column:
    """Weighted similarity of two functions in different languages; 0.3 or more counts as a clone."""
    return F.round(0.6 * skeleton + 0.25 * tokens + 0.15 * run, 6)
