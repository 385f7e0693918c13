"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most 3 of 64 bits differ in at most one bit of one of their halves. For each half the anchors
are the words of the perfect Hamming code of length 31 (a covering code of radius 1; the half's last bit is left out, which
only brings fingerprints closer). A fingerprint is replicated to every anchor within radius plus threshold, 1 + 1: up to 16 of
2**26 anchors a half. Of two linked fingerprints, each stands at the other's nearest anchor, so comparing all 64 bits of those
that meet at an anchor finds every link. Equal fingerprints are one before that; what an anchor sends on is not pairs but a
star for each local component, at most a row for each fingerprint. Large anchors are searched by exact bytes of the other
half. Components over all anchors come from alternating large-star and small-star rounds over written tables.

Defined cases: a null or empty text, or one without words, has the fingerprint zero, linked like any other; fewer words than a
shingle are one shingle; null doc_ids take part and are never a component's id unless it has no other; repeated rows
are answered one by one; other columns don't matter; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, ship, sliced, width, written

SHINGLE = 3
THRESHOLD = 3
SEED = 42
#: Rows of an anchor compared by neighbouring positions; larger anchors by bytes of the other half.
LAGS = 48
#: Tasks over which the rows of a hub (a node with many edges, a component of many fingerprints) are dealt out.
SALTS = 64
#: Rows of anchors compared together.
CHUNK = 1 << 18
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    words = text.lower().split()  # bytes: A-Z only, and white space is 32 and 9 to 13
    if len(words) < size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    return [joined[a:z] for a, z in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles(text, size)], np.uint64)
    if not len(hashes):
        return 0
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, row_hash (of the text) and fp (64 bits in a long) for each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 4 << 20):
            fps = np.array([fingerprint(t, size) for t in byte_texts(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "row_hash", "fp"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row_hash"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, row_hash long, fp long")


_CHECKS = [sum(1 << p - 1 for p in range(1, 32) if p >> k & 1) for k in range(5)]
#: For each syndrome, what to flip to reach each anchor within 2: the code word at 1, then those at 2. Unused places repeat.
_FLIPS = np.zeros((32, 16), np.uint64)
for _s in range(1, 32):
    _pairs = [(0, _s)] + [(i, i ^ _s) for i in range(1, 32) if i < (i ^ _s)]
    _FLIPS[_s] = [sum(1 << p - 1 for p in pair if p) for pair in _pairs]


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 32-bit halves: the anchors within 2, up to 16 each, and which rows they belong to."""
    word = half & np.uint64(0x7FFFFFFF)
    syndrome = np.zeros(len(word), np.int64)
    for k, mask in enumerate(_CHECKS):
        syndrome |= (np.bitwise_count(word & np.uint64(mask)).astype(np.int64) & 1) << k
    found = word[:, None] ^ _FLIPS[syndrome]
    used = np.ones(found.shape, bool)
    used[syndrome == 0, 1:] = False
    rows = np.broadcast_to(np.arange(len(word))[:, None], found.shape)
    return found[used], rows[used]


def replicate(distinct: DataFrame) -> DataFrame:
    """anchor and fp for every anchor of every fingerprint; the anchors of the second half have bit 32 set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 10_000):
                fp = b.column(0).slice(i, 10_000).to_numpy().view(np.uint64)
                for k in (0, 1):
                    a, rows = anchors((fp >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF))
                    yield pa.RecordBatch.from_arrays([pa.array((a | np.uint64(k << 32)).view(np.int64)), pa.array(fp[rows].view(np.int64))], ["anchor", "fp"])

    return distinct.mapInArrow(run, "anchor long, fp long")


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, by hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(la[apart], lb[apart]), np.minimum(la[apart], lb[apart]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _links_in_order(key: np.ndarray, fp: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked fingerprints of equal keys, for keys in order that have at most so many rows."""
    out, at = [], np.arange(len(key))
    for lag in range(1, most):
        at = at[at < len(key) - lag]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        near = np.bitwise_count(fp[at] ^ fp[at + lag]) <= THRESHOLD
        out.append((at[near], at[near] + lag))
    return out


def _links_in_large(fp: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the linked fingerprints of one large anchor: those linked agree in a byte of the other half."""
    label = np.arange(len(fp))
    for k in range(4):
        byte = (other >> np.uint64(8 * k)) & np.uint64(255)
        order = np.argsort(byte, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(byte[order])) + 1).tolist(), len(order)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            rows = order[lo:hi]
            for i in range(0, len(rows), 256):
                if (label[rows] == label[rows[0]]).all():
                    break  # all are linked already
                part = rows[i : i + 256]
                for j in range(i, len(rows), 8192):
                    rest = rows[j : j + 8192]
                    x, y = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[rest][None, :]) <= THRESHOLD)
                    apart = label[part[x]] != label[rest[y]]
                    if apart.any():
                        own = np.flatnonzero(label != np.arange(len(label)))
                        label = local_components(len(fp), np.concatenate([own, part[x[apart]]]), np.concatenate([label[own], rest[y[apart]]]))
    child = np.flatnonzero(label != np.arange(len(label)))
    return child, label[child]


def stars(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and the smallest fingerprint of their component among these rows, where that is another."""
    starts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    sizes = np.diff(np.concatenate([starts, [len(anchor)]]))
    small = np.repeat(sizes <= LAGS, sizes)
    at = np.flatnonzero(small & np.repeat(sizes > 1, sizes))
    pairs = [(at[x], at[y]) for x, y in _links_in_order(anchor[at], fp[at], LAGS)]
    for lo, n in zip(starts[sizes > LAGS].tolist(), sizes[sizes > LAGS].tolist(), strict=True):
        own = fp[lo : lo + n]
        used = int(anchor[lo]) >> 32 & 1
        x, y = _links_in_large(own, (own >> np.uint64(0 if used else 32)) & np.uint64(0xFFFFFFFF))
        pairs.append((x + lo, y + lo))
    if not pairs:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = fp[np.concatenate([x for x, _ in pairs])], fp[np.concatenate([y for _, y in pairs])]
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = local_components(len(nodes), index[: len(a)], index[len(a) :])
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush(everything: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        anchor, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        cut = len(anchor) if everything else int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
        if cut < len(anchor):
            held.append((anchor[cut:], fp[cut:]))
        if cut:
            a, b = stars(anchor[:cut], fp[:cut])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    size = 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)))
        size += b.num_rows
        if size >= CHUNK:
            yield from flush(False)
            size = sum(len(x) for x, _ in held)
            size = 0 if size >= CHUNK else size  # a large anchor is read to its end in steps of CHUNK
    yield from flush(True)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) between fingerprints with the same components as all links; distinct has a column fp without repeats."""
    spread = replicate(distinct.select("fp")).repartition(width(distinct.sparkSession), "anchor").sortWithinPartitions("anchor")
    return spread.mapInArrow(_compare, "u long, v long")


def _with_least(df: DataFrame, key: str, value: str, salt: str, name: str) -> DataFrame:
    """df and the least value of each key. A hub's rows are dealt out by the column salt: tasks find the least of a key and salt,
    only those (SALTS at most) meet by key, and the answer returns to each salt."""
    salted = df.withColumn("__s", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    parts = salted.groupBy(key, "__s").agg(F.min(value).alias("__m"))
    least = parts.groupBy(key).agg(F.min("__m").alias(name), F.collect_list("__s").alias("__s")).select(key, name, F.explode("__s").alias("__s"))
    return salted.join(least, [key, "__s"]).drop("__s")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of edges (u, v), by large-star and small-star rounds."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(df: DataFrame) -> tuple[int, int]:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = _with_least(both, "u", "v", "v", "m").where("v > u")
        large = up.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        small = _with_least(large, "u", "v", "v", "m").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u <> v").distinct(), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, row_hash, fp and component_id (the smallest doc_id reachable over links) for each row."""
    fps = written(fingerprints(docs, size), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comp = components(links(distinct))
    member = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    member = written(member, "members")
    by_fp = _with_least(member, "component", "low", "fp", "component_id").select("fp", "component_id")
    return fps.join(by_fp, "fp", "left").select("doc_id", "row_hash", "fp", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The documents of which each group's first stays: that with the smallest doc_id (and hash of its text), once."""
    near = written(near_duplicates(docs, size), "near")
    first = near.groupBy(F.col("component_id").alias("__c")).agg(F.min(F.struct("doc_id", "row_hash")).alias("__k"))
    return _only(docs, first.select(F.col("__k.doc_id").alias("__id"), F.col("__k.row_hash").alias("__hash")))


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    marked = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__hash": F.xxhash64(F.col("text").cast("string"))})
    same = marked["__id"].eqNullSafe(keys["__id"]) & (marked["__hash"] == keys["__hash"])
    kept = marked.join(keys, same, "left_semi")
    once = Window.partitionBy("__id", "__hash").orderBy(F.lit(1))
    return kept.withColumn("__n", F.row_number().over(once)).where("__n = 1").select(*docs.columns)


def brute_force(rows: list[tuple[int | None, str | None]], size: int = SHINGLE) -> list[tuple[int | None, str, int | None]]:
    """The same by definition, for tests."""
    fps = [fingerprint((t or "").encode(), size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= THRESHOLD:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(d, f"{f:016x}", low.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))]
