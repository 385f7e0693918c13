"""URL filters: host and path rules first, then logistic regression on hashed character n-grams of host and path.

All of it is DataFrame and SQL functions. A url is cut into host and path by expressions; the n-grams of each (3 to 5
characters, host and path apart) are hashed into BUCKETS, and a url's margin is the bias plus the sum of its n-grams'
weights over the root of their number. Training works on a fixed table of labelled urls: n-grams become (url, bucket, value)
rows, inner products of urls come from a join on buckets, gradient ascent on the dual coefficients is a fold over an
array column, and the weights are sums by bucket. Only the weights (at most BUCKETS numbers) reach the driver, and go into
the scoring expression as one literal.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and gets the bias alone; repeated rows are
judged one by one; very long urls take time in proportion; other columns don't matter; an empty table gives no row.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BUCKETS = 4096
GRAMS = (3, 4, 5)
STEPS = 150
RATE = 0.5
DECAY = 0.002
CUT = 0.5

#: The labelled url table's names, of our own invention: sites that a corpus wants, and sites that it doesn't. Domains and
#: paths go round alike for both, so the labels tell names and page kinds apart and not domains or languages.
WANTED = """
rivernews hillside lantern meadow college townpaper museum birdwatch kitchen coast parliament county quill school letters
science workshop poetry weather history hikers daily notes garden film opera theatre harbour thistle orchard thornton easter
""".split()
UNWANTED = """
ads-track banner-ads click-ads pixel-track casino-bonus casino-royal bet-win free-spins free-prize buy-pills cheap-meds pills-shop
crack-warez keygen-free hot-cams xxx-cams fast-loans payday-cash seo-links link-farm spam-offer spam-links popunder-ads win-prize
lottery-win replica-shop hot-deals torrent-free ad-click malware-update bets-online doorway-farm
""".split()
WANTED_PAGES = ("article", "wiki", "archive", "lesson")
UNWANTED_PAGES = ("click", "banner", "redirect", "popup")
DOMAINS = ("example.com", "example.org", "example.net")
FOLDERS = ("en", "de", "fr", "es")
FRONTS = ("", "www.", "m.", "blog.")


def table_urls() -> list[tuple[str, int]]:
    """(url, 1 to block) of the training table."""
    rows = []
    for y, names, kinds in ((0, WANTED, WANTED_PAGES), (1, UNWANTED, UNWANTED_PAGES)):
        for i, name in enumerate(names):
            for k, domain in enumerate(DOMAINS):
                page = f"{kinds[i % len(kinds)]}/{41 * i + k}" if k == 2 else f"{1000 + 41 * i + k}"
                rows.append((f"http://{FRONTS[(i + k) % 4]}{name}.{domain}/{FOLDERS[(i + 2 * k) % 4]}/{page}", y))
    return rows


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _buckets(kind: str, text: Column) -> Column:
    """The buckets of a text's n-grams, one for each place, as an array."""
    chars = _characters(text)

    def of(n: int) -> Column:
        def bucket(i: Column) -> Column:
            gram = F.array_join(F.slice(chars, i, n), "")
            return F.pmod(F.xxhash64(F.lit(f"{kind}{n}"), gram), F.lit(BUCKETS)).cast("int")

        return F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(1), F.size(chars) - (n - 1)), bucket)).otherwise(F.array().cast("array<int>"))

    return F.concat(*(of(n) for n in GRAMS))


def with_buckets(df: DataFrame) -> DataFrame:
    """Adds __grams, all buckets of columns host and path."""
    return df.withColumn("__grams", F.concat(_buckets("h", F.col("host")), _buckets("p", F.col("path"))))


def labelled(spark: SparkSession) -> DataFrame:
    """The training table: id, url, y (1: block)."""
    urls = [(i, u, y) for i, (u, y) in enumerate(table_urls())]
    return spark.sql("select * from values " + ", ".join(f"({i}, '{u}', {y}.0D)" for i, u, y in urls) + " as t(id, url, y)")


def train(table: DataFrame) -> tuple[list[float], float]:
    """Weights by bucket, and the bias, from a labelled table (id: 0 to n-1, url, y)."""
    host, path = url_parts(F.col("url"))
    rows = with_buckets(table.select("id", "y", host.alias("host"), path.alias("path")))
    rows = rows.select("id", "y", F.explode("__grams").alias("bucket"), F.size("__grams").alias("n"))
    value = rows.groupBy("id", "y", "bucket").agg((F.count("*") / F.sqrt(F.max("n"))).alias("x"))
    other = value.select(F.col("id").alias("jd"), "bucket", F.col("x").alias("z"))
    inner = value.join(other, "bucket").groupBy("id", "y", "jd").agg(F.sum(F.col("x") * F.col("z")).alias("k"))
    line = inner.groupBy("id", "y").agg(F.sort_array(F.collect_list(F.struct("jd", "k"))).alias("ks"))  # all urls share "example", so no product is missing
    whole = line.agg(F.sort_array(F.collect_list(F.struct("id", "y", F.col("ks.k").alias("k")))).alias("all"))

    # alpha += RATE * (y - sigmoid(K alpha + sum alpha)) - decay; the bias is a constant feature, so its weight is sum alpha
    def step(alpha: Column, _: Column) -> Column:
        bias = F.aggregate(alpha, F.lit(0.0), lambda s, a: s + a)

        def one(r: Column, i: Column) -> Column:
            margin = F.aggregate(F.zip_with(r["k"], alpha, lambda k, a: k * a), F.lit(0.0), lambda s, v: s + v) + bias
            old = F.get(alpha, i)
            return old + RATE * (r["y"] - 1 / (1 + F.exp(-margin)) - DECAY * old)

        return F.transform("all", one)

    start = F.transform("all", lambda r: F.lit(0.0))
    alphas = whole.select(F.explode(F.arrays_zip(F.col("all.id").alias("id"), F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("alpha"))).alias("a")).select("a.id", "a.alpha")
    alphas = alphas.groupBy("id").agg(F.max("alpha").alias("alpha"))
    weights = value.join(alphas, "id").groupBy("bucket").agg(F.sum(F.round(F.col("alpha") * F.col("x"), 12)).alias("w"))
    found = {r["bucket"]: round(r["w"], 9) for r in weights.collect()}  # at most BUCKETS rows
    bias = alphas.agg(F.sum("alpha").alias("b")).first()["b"]
    return [found.get(b, 0.0) for b in range(BUCKETS)], round(bias, 9)


def block_score(weights: list[float], bias: float) -> Column:
    """The probability of block from the column __grams."""
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded into one literal
    total = F.aggregate("__grams", F.lit(0.0), lambda s, b: s + F.get(w, b))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size("__grams"), F.lit(1))) + bias)))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones, which are longer, stand in front
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's probability of block) for each row."""
    weights, bias = train(labelled(pages.sparkSession))
    host, path = url_parts(F.col("url").cast("string"))
    parts = with_buckets(pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")))
    scored = parts.withColumn("score", block_score(weights, bias))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= CUT, "block").otherwise("allow")).alias("verdict"), F.round("score", 6).alias("score"))
