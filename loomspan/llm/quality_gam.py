"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically.

Each feature of a text is cut into quantile bins and has a lookup table; boosting goes round the features, and each time
adds a tree of at most three leaves on one feature, fitted to the gradient of the log loss with Newton leaves, to that
feature's table. Then the pairs whose residual gradients a four-way split explains best get a table over both features'
bins, boosted in the same way with trees of depth two. A score is the intercept and the tables' values at a text's bins, added and
squashed: a vectorised addition.

The model is fitted on the driver on at most TRAIN_ROWS labelled rows, those with the smallest hashes of doc_id; features
of whole texts are the only inputs of a score.

Defined cases: null and empty texts have the features of no words and are scored like others; labels that are null, or whose
document isn't there, don't count; without labels (or with one class only) all scores are the mean label, 0.5 if there is none;
repeated rows are scored one by one; other columns don't matter; an empty table gives no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, ship, sliced

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
HELD_OUT_MOD = 5
CUT = 0.3
BINS = 64
ROUNDS = 150
RATE = 0.1
PAIRS = 6
PAIR_BINS = 16
PAIR_ROUNDS = 60
#: Added to a leaf's Hessian, and the least Hessian of a leaf.
SHRINK = 1.0
LEAST = 2.0

FEATURES = (
    "log_words", "word_bytes", "upper", "digit", "mark", "symbol", "bar", "bang", "high", "space", "entropy",
    "distinct", "top_word", "line_words", "same_lines", "no_letter_words", "long_words", "caps_words", "marks_a_word", "top_bytes",
)
_UPPER, _LOWER, _DIGIT, _HIGH = slice(65, 91), slice(97, 123), slice(48, 58), slice(128, 256)
_MARKS = np.array([x for x in range(33, 127) if not chr(x).isalnum()])
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@\\^_`|~{}[]", np.uint8).astype(int)


def features(text: bytes) -> list[float]:
    n, words, lines = max(1, len(text)), text.split(), [x for x in text.split(b"\n") if x.strip()]
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    w, share = max(1, len(words)), h[h > 0] / n
    counts = Counter(words)
    top = max(counts.values(), default=0)
    marks = int(h[_MARKS].sum())
    distinct = counts.keys()
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / w,
        float(h[_UPPER].sum()) / n,
        float(h[_DIGIT].sum()) / n,
        marks / n,
        float(h[_SYMBOLS].sum()) / n,
        float(h[124]) / n,
        float(h[33]) / n,
        float(h[_HIGH].sum()) / n,
        float(h[[9, 10, 13, 32]].sum()) / n,
        float(-(share * np.log2(share)).sum()) if len(share) else 0.0,
        len(counts) / w,
        top / w,
        len(words) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(counts[x] for x in distinct if not x[:1].isalpha() and x[0] < 128) / w,
        sum(counts[x] for x in distinct if len(x) > 20) / w,
        sum(counts[x] for x in distinct if len(x) > 2 and x.isupper()) / w,
        marks / w,
        float(np.sort(h)[-4:].sum()) / n,
    ]


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best single cut of a row of bins."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    lg, lh, rg, rh = cg[:-1], ch[:-1], cg[-1] - cg[:-1], ch[-1] - ch[:-1]
    gain = np.where((lh >= LEAST) & (rh >= LEAST), _gain(lg, lh) + _gain(rg, rh) - _gain(cg[-1:], ch[-1:]), 0.0)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A step per bin: a tree of at most three leaves."""
    gain, at = _best_cut(g, h)
    parts = [(0, len(g))]
    if gain > 0:
        parts = [(0, at), (at, len(g))]
        more = [(*_best_cut(g[lo:hi], h[lo:hi]), k) for k, (lo, hi) in enumerate(parts)]
        best, cut, k = max(more, key=lambda x: (x[0], -x[2]))
        if best > 0:
            lo, hi = parts[k]
            parts[k : k + 1] = [(lo, lo + cut), (lo + cut, hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + SHRINK)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A step per cell of two features' bins, by one cut of a feature and then one of the other on each side; and its gain."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        _, at = _best_cut(gg.sum(axis=1), hh.sum(axis=1))
        step, gain = np.zeros_like(gg), 0.0
        for lo, hi in ((0, at), (at, len(gg))):
            if lo == hi:
                continue
            a, b = gg[lo:hi].sum(axis=0), hh[lo:hi].sum(axis=0)
            _, cut = _best_cut(a, b)
            for x, y in ((0, cut), (cut, len(a))):
                if x < y:
                    step[lo:hi, x:y] = a[x:y].sum() / (b[x:y].sum() + SHRINK)
                    gain += float(_gain(a[x:y].sum(), b[x:y].sum()))
        if gain > best:
            best, out = gain, step.T.copy() if flip else step
    return best, out


@dataclass
class Gam:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        if not self.edges:
            return out
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        for b, t in zip(bins, self.tables, strict=True):
            out += t[b]
        for i, j, t in self.pairs:
            out += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """The model for features x and labels y (0 or 1)."""
    if not len(y):
        return Gam()
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    gam = Gam(float(np.log(mean / (1 - mean))))
    if len(set(y.tolist())) < 2:
        return gam
    bins = []
    for j in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        gam.edges.append(edges)
        bins.append(np.searchsorted(edges, x[:, j], side="right"))
        gam.tables.append(np.zeros(len(edges) + 1))
        gam.coarse.append(np.arange(len(edges) + 1) * PAIR_BINS // (len(edges) + 1))
    f = np.full(len(y), gam.intercept)
    for _ in range(ROUNDS):
        for b, table in zip(bins, gam.tables, strict=True):
            p = 1 / (1 + np.exp(-f))
            step = RATE * _tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
            table += step
            f += step[b]
    rough = [gam.coarse[j][bins[j]] for j in range(len(bins))]
    p = 1 / (1 + np.exp(-f))

    def cells(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(rough[i] * PAIR_BINS + rough[j], v, PAIR_BINS * PAIR_BINS).reshape(PAIR_BINS, PAIR_BINS)

    ranked = sorted(((_pair_tree(cells(i, j, y - p), cells(i, j, p * (1 - p)))[0], i, j) for i in range(len(bins)) for j in range(i)), reverse=True)
    gam.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in gam.pairs:
            p = 1 / (1 + np.exp(-f))
            step = RATE * _pair_tree(cells(i, j, y - p), cells(i, j, p * (1 - p)))[1]
            table += step
            f += step[rough[i], rough[j]]
    for t in gam.tables:
        t -= (shift := float(t.mean()))
        gam.intercept += shift
    return gam


def _rest(doc_id, mod: int):  # noqa: ANN001, ANN202
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Gam:
    """Fitted on at most so many labelled documents outside the held-out fifth."""
    ship(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__y")).where(F.col("__y").isin(0, 1) & (_rest(F.col("__id"), HELD_OUT_MOD) != 0))
    usable = usable.withColumn("__h", F.xxhash64("__id"))
    n = usable.count()
    if n > rows:  # the rows of the smallest hashes, about: their number has a spread of its root
        usable = usable.where(F.col("__h") < int(-(1 << 63) + (1 << 64) * (rows - 4 * rows**0.5) / n))
    sample = F.broadcast(usable.groupBy("__id", "__h").agg(F.max("__y").alias("__y")))  # at most `rows` rows of three numbers
    chosen = docs.select(F.col("doc_id").cast("long").alias("__d"), F.col("text").cast("string").alias("text")).join(sample, F.col("__d") == F.col("__id")).select("__h", "__y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 4 << 20):
            x = matrix(byte_texts(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["h", "y", "x"])

    found = sorted((r["h"], r["y"], r["x"]) for r in chosen.mapInArrow(run, "h long, y int, x array<double>").toLocalIterator())[:rows]
    return fit(np.array([r[2] for r in found], np.float64).reshape(-1, len(FEATURES)), np.array([r[1] for r in found], np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    gam = train(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gam.score(matrix(byte_texts(b.column(1)))))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(_rest(F.col("doc_id"), HELD_OUT_MOD) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns."""
    gam, at = train(docs, labels, rows), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 4 << 20):
            yield b.filter(pa.array(gam.score(matrix(byte_texts(b.column(at)))) >= CUT))

    return docs.mapInArrow(run, docs.schema)
