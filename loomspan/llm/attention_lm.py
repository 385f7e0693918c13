"""LM scoring: a causal self-attention model over subword ids, trained in numpy, beside an add-one unigram base.

Words are the text's (A-Z lower-cased, cut at white space), each document closed by an end. Their counts over all training
documents are a distributed aggregation. The most frequent words (at most HOT_WORDS) go with their counts and subword ids into one
file in the shared folder, which bounds what a worker holds; the base's sums for all other words come from a join of (row,
word, occurrences) with the counts. Subword ids are counted over all words, in a pass over the counts.

The model reads subword ids of a public vocabulary: embeddings, one causal attention head with a bias by distance, a residual
sum, and an adaptive softmax over CLASSES classes (the most frequent ids each, the others in clusters by what stands beside them in
words, with their share of the class as counted) in two levels: GROUPS groups of alike classes, and the classes of a group. It starts from the low-rank factors of the bigram log ratios of all training ids and
is trained by local Adam on every task's windows with parameters averaged between rounds. Training windows of SPAN ids lie side by
side over the whole of every training document, its end included. A text is scored in windows of SPAN ids
that overlap by SPAN - STEP: each id is scored once, with SPAN - STEP to SPAN ids of context where the text has them; all
windows of a batch go through batched masked attention.

Defined cases: null and empty texts have the end alone; a null doc_id is a training document; without training documents all
counts are 0 and the model is uniform over classes; repeated rows are counted and scored one by one; other columns don't
matter; an empty table gives no row.
"""

from __future__ import annotations

import io
import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, on_change, scratch, ship, sliced, split_path, texts_of, turn_to, width, written
from .token_store import WordEncoder, default_tokenizer, gathered

HELD_MOD, HELD_REST = 7, 2
#: Words held by every worker, at most, and the longest of them in bytes.
HOT_WORDS, HOT_BYTES = 1 << 18, 64
DIM = 24
CLASSES, SINGLE = 224, 160
#: The softmax over classes has two levels: groups of neighbouring classes, and the classes of a group.
GROUPS = 8
#: Ids with an embedding of their own; the others share RARE embeddings.
INPUTS, RARE = 2048, 64
SPAN, STEP = 32, 24
#: Windows in a row of the table of training windows, at most: readers and Arrow hold thousands of rows at once.
PART_WINDOWS = 8
#: Each round uses all of a task's windows once, at every size.
ROUNDS, BATCH, RATE = 2, 48, 0.01
#: A local run has so many steps or more, else fewer tasks train.
TASK_STEPS = 100
#: Numbers of a model that a step changes together: what belongs to them stays in a core's cache.
ADAM_PART = 1 << 13
#: Ids scored together, which bounds the arrays of positions.
PART_IDS = 300_000
END = b"\n"  # not a word, as it is white space
NO_CLASS = 255


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_MOD == HELD_REST


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words of all texts in a row, and the n+1 word offsets of the texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    words, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    return words.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[bounds]


def merged(batches: Iterator[pa.RecordBatch], least_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have about so many bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.get_total_buffer_size()
        if size >= least_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n over all training documents; the end is the word "\\n"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("counting")  # needs nothing that other tasks hold
        for b in merged(sliced(batches, "text", 16 << 20, 40_000), 16 << 20):  # fewer partial counts
            words, bounds = split_words(b.column(1))
            training = np.array([not held_out(d) for d in b.column(0).to_pylist()])
            used = np.repeat(training, np.diff(bounds))
            if training.any():
                coded = words.dictionary_encode()
                n = np.bincount(coded.indices.to_numpy()[used], minlength=len(coded.dictionary))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(at)), pa.array(n[at])], ["word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([END.decode()]), pa.array([int(training.sum())], pa.int64())], ["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Hot:
    """The frequent words: counts, and subword ids one after another (of word i: flat[starts[i]:starts[i+1]])."""

    words: pa.Array
    counts: np.ndarray
    flat: np.ndarray
    starts: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        t = pa.table({"w": self.words, "n": self.counts, "k": np.diff(self.starts)})
        with pa.ipc.new_stream(out, t.schema) as s:
            s.write_table(t)
        body = out.getvalue()
        return len(body).to_bytes(8, "little") + body + self.flat.astype("<i4").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Hot:
        n = int.from_bytes(raw[:8], "little")
        t = pa.ipc.open_stream(raw[8 : 8 + n]).read_all()
        return cls(t["w"].combine_chunks(), t["n"].to_numpy(), np.frombuffer(raw, "<i4", offset=8 + n), np.concatenate([[0], np.cumsum(t["k"].to_numpy())]))


def _ids(encoder: WordEncoder, words: list[str]) -> list[list[int]]:
    out = []
    for i in range(0, len(words), 5_000):
        out += [e.ids for e in encoder.tokenizer.encode_batch_fast(words[i : i + 5_000], add_special_tokens=False)]
    return out


def choose_hot(counts: DataFrame, tokenizer: str, most: int) -> Hot:
    """Words from the least count with which at most so many are left."""
    usable = counts.where((F.octet_length("word") <= HOT_BYTES) & (F.col("word") != END.decode()))
    by_count = usable.groupBy("n").agg(F.count("*").alias("words")).collect()  # as many rows as there are different counts: below the root of twice the corpus
    least, total = math.inf, 0
    for r in sorted(by_count, key=lambda r: -r["n"]):
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    rows = sorted((r["word"], r["n"]) for r in usable.where(F.col("n") >= least).toLocalIterator()) if least < math.inf else []
    ids = _ids(WordEncoder.of(tokenizer), [w for w, _ in rows])
    return Hot(pa.array([w for w, _ in rows], pa.string()), np.array([n for _, n in rows], np.int64), np.array([i for x in ids for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]))


@dataclass
class Shape:
    """What is fixed about the model: the class and row of each id, and an id's share of its class (log10). Neighbouring classes are alike."""

    size: int
    end: int
    classes: np.ndarray
    share: np.ndarray
    rows: np.ndarray


def _beside(seen: np.ndarray, flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, chosen: np.ndarray, heads: np.ndarray, size: int) -> None:
    """Adds to seen (chosen id, head before it, head after it, word begins, word ends) what these words have."""
    place, head = np.full(size, -1), np.full(size, -1)
    place[chosen], head[heads] = np.arange(len(chosen)), np.arange(len(heads))
    weight = np.repeat(counts, np.diff(starts)).astype(np.float64)
    word = np.repeat(np.arange(len(counts)), np.diff(starts))
    inner = word[1:] == word[:-1] if len(word) else np.zeros(0, bool)
    for here, there, off in ((flat[1:], flat[:-1], 0), (flat[:-1], flat[1:], len(heads))):
        use = inner & (place[here] >= 0)
        edge = use & (head[there] >= 0)
        np.add.at(seen, (place[here[edge]], off + head[there[edge]]), weight[1:][edge])
    for side, first in ((starts[:-1], 2 * len(heads)), (starts[1:] - 1, 2 * len(heads) + 1)):
        filled = np.diff(starts) > 0
        at = flat[side[filled]]
        use = place[at] >= 0
        np.add.at(seen, (place[at[use]], first), counts[filled][use].astype(np.float64))


def _clusters(seen: np.ndarray, mass: np.ndarray, k: int) -> np.ndarray:
    """k groups of ids by what stands beside them in words (k-means on root shares, weighted by mass)."""
    x = np.sqrt(seen / np.maximum(seen.sum(axis=1, keepdims=True), 1))
    rng = np.random.default_rng(7)
    centre = x[np.sort(rng.choice(len(x), k, replace=False, p=mass / mass.sum()))]
    for _ in range(12):
        group = np.argmin((centre * centre).sum(axis=1)[None, :] - 2 * x @ centre.T, axis=1)
        for g in range(k):
            if (own := group == g).any():
                centre[g] = np.average(x[own], axis=0, weights=mass[own])
    return group


def _alike(seen: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """The classes in an order in which each GROUPS-th part stands beside like ids: halved again and again along the main axis of root shares."""
    x = np.sqrt(seen / np.maximum(seen.sum(axis=1, keepdims=True), 1))

    def halves(own: np.ndarray, parts: int) -> list[np.ndarray]:
        if parts == 1:
            return [own]
        z = (x[own] - np.average(x[own], axis=0, weights=mass[own])) * np.sqrt(mass[own])[:, None]
        axis = np.linalg.svd(z, full_matrices=False)[2][0]
        own = own[np.argsort(x[own] @ axis, kind="stable")]
        return [*halves(own[: len(own) // 2], parts // 2), *halves(own[len(own) // 2 :], parts // 2)]

    return np.concatenate(halves(np.arange(len(x)), GROUPS))


def _shape(n: np.ndarray, beside: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Shape:
    """From the counts of all ids, of which the last is the end; beside gives what stands beside chosen ids, given these and the heads."""
    size = len(n)
    order = np.lexsort((np.arange(size), -n))
    mass = n + 0.5
    classes = np.full(size, CLASSES - 1, np.int64)  # the last class is for ids without an embedding of their own
    classes[order[:SINGLE]] = np.arange(SINGLE)
    tail = order[SINGLE:INPUTS]
    seen = beside(order[:INPUTS], order[:SINGLE])
    classes[tail] = SINGLE + _clusters(seen[SINGLE:], mass[tail], CLASSES - SINGLE - 1)
    of_class = np.zeros((CLASSES, seen.shape[1]))
    np.add.at(of_class, classes[order[:INPUTS]], seen)
    place = np.empty(CLASSES, np.int64)
    place[_alike(of_class, np.bincount(classes, mass, CLASSES))] = np.arange(CLASSES)
    classes = place[classes]
    rows = np.empty(size, np.int64)
    rows[order[:INPUTS]] = np.arange(INPUTS)
    rows[order[INPUTS:]] = INPUTS + order[INPUTS:] % RARE
    return Shape(size, size - 1, classes, np.log10(mass / np.bincount(classes, mass, CLASSES)[classes]), rows)


def shape_of(hot: Hot, ends: int, size: int) -> Shape:
    """Of a corpus whose words are all in hot."""
    n = np.bincount(hot.flat, np.repeat(hot.counts, np.diff(hot.starts)), minlength=size)
    n[size - 1] = ends

    def beside(chosen: np.ndarray, heads: np.ndarray) -> np.ndarray:
        seen = np.zeros((len(chosen), 2 * len(heads) + 2))
        _beside(seen, hot.flat, hot.starts, hot.counts, chosen, heads, size)
        return seen

    return _shape(n, beside)


def corpus_shape(counts: DataFrame, tokenizer: str, ends: int, size: int) -> Shape:
    """Of the words of all rows of counts, encoded once on the executors; the driver gets sums by id and by (id, neighbour)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for b in merged(sliced(batches, "word", 4 << 20, 40_000), 4 << 20):
            ids, each = encoder.encode(b.column(0))
            encoder.forget()  # no word comes twice
            packed = [x.astype(kind).tobytes() for x, kind in ((ids, "<i4"), (each, "<i4"), (b.column(1).to_numpy(), "<i8"))]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], ["ids", "each", "n"])

    words = counts.where(F.col("word") != END.decode()).select("word", "n")
    coded = written(words.mapInArrow(encode, "ids binary, each binary, n binary"), "coded")

    def summed(cells: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(cells)
            for b in batches:
                for ids, each, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    add(total, np.frombuffer(ids, "<i4").astype(np.int64), np.concatenate([[0], np.cumsum(np.frombuffer(each, "<i4"))]), np.frombuffer(n, "<i8"))
            at = np.flatnonzero(total)
            for i in range(0, len(at), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(total[at[i : i + 50_000]].astype(np.int64))], ["cell", "n"])

        out = np.zeros(cells)
        for r in coded.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():  # at most `cells` rows
            out[r["cell"]] = r["n"]
        return out

    def count(total: np.ndarray, flat: np.ndarray, starts: np.ndarray, n: np.ndarray) -> None:
        total += np.bincount(flat, np.repeat(n, np.diff(starts)), minlength=size)

    def beside(chosen: np.ndarray, heads: np.ndarray) -> np.ndarray:
        sides = 2 * len(heads) + 2
        return summed(len(chosen) * sides, lambda total, flat, starts, n: _beside(total.reshape(-1, sides), flat, starts, n, chosen, heads, size)).reshape(-1, sides)

    n = summed(size, count)
    n[size - 1] = ends
    return _shape(n, beside)


Params = dict[str, np.ndarray]
PAD = INPUTS + RARE
WITHIN = CLASSES // GROUPS


def initial(bigrams: np.ndarray) -> Params:
    """From counts (row, class): biases are the log frequencies of classes in their groups and of groups, embeddings and head the factors
    of the log ratios. Columns of head and bias: the classes, group by group, then the groups."""
    q = (bigrams.sum(axis=0) + 1) / (bigrams.sum() + CLASSES)
    n = bigrams + 30 * q  # rare rows lean on the unigram

    def levels(of: np.ndarray) -> np.ndarray:
        group = of.reshape(*of.shape[:-1], GROUPS, WITHIN).sum(axis=-1)
        return np.concatenate([of / np.repeat(group, WITHIN, axis=-1), group], axis=-1)

    p, usual = levels(n / n.sum(axis=1, keepdims=True)), levels(q)
    weight = np.sqrt(bigrams.sum(axis=1) + 1)[:, None]
    back = np.sqrt(np.concatenate([q, usual[CLASSES:]]))[None, :]
    u, s, v = np.linalg.svd(np.clip(np.log(p / usual), -6, 6) * weight * back, full_matrices=False)
    u, s, v = u[:, :DIM], s[:DIM], v[:DIM]
    scale = np.sqrt(s / np.sqrt(len(bigrams)))
    rng = np.random.default_rng(7)
    eye = np.eye(DIM)
    return {
        k: x.astype(np.float32)
        for k, x in {
            "embed": u * np.sqrt(s * np.sqrt(len(bigrams))) / weight, "head": scale[:, None] * v / back, "bias": np.log(usual),
            "wq": eye + rng.normal(0, 0.02, (DIM, DIM)), "wk": eye * 0.5 + rng.normal(0, 0.02, (DIM, DIM)), "wv": rng.normal(0, 0.02, (DIM, DIM)), "far": np.zeros(SPAN),
        }.items()
    }


_AGE = np.arange(SPAN)[:, None] - np.arange(SPAN)[None, :]
_LOOK = np.where(_AGE < 0, SPAN, _AGE)  # the place after all ages is that of what is yet to come
_PAIRS = np.arange(PAD)[:, None] * (DIM // 2) + np.arange(DIM // 2)  # an embedding's cells, two by two
_IN = np.tile(np.arange(WITHIN), GROUPS)


def _fits(z: np.ndarray, more: float = 0.0) -> bool:
    """Whether no exponential of z, moved by more, can overflow or vanish: then no maximum needs to be taken off its rows."""
    return not z.size or (float(z.max()) + more < 80 and float(z.min()) - more > -80)


def _below(z: np.ndarray) -> np.ndarray:
    """z, with its rows' maxima taken off in place where its exponentials need it."""
    if not _fits(z):
        z -= z.max(axis=-1, keepdims=True)
    return z


def head_parts(p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The head of groups (DIM + 1, GROUPS) and those of their classes (GROUPS, DIM + 1, WITHIN); the last row is the bias."""
    head = np.vstack([p["head"], p["bias"][None]])
    return np.ascontiguousarray(head[:, CLASSES:]), np.ascontiguousarray(head[:, :CLASSES].reshape(-1, GROUPS, WITHIN).transpose(1, 0, 2))


def by_class(goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Places with a class (none: -1) in the order of classes, their classes, and (group, begin, end) of the groups that occur."""
    order = np.argsort(goal.astype(np.int16), kind="stable")
    classes = goal.take(order)
    ends = np.searchsorted(classes, np.arange(GROUPS + 1) * WITHIN).tolist()
    if first := ends[0]:
        order, classes = order[first:], classes[first:]
    return order, classes, [(g, ends[g] - first, ends[g + 1] - first) for g in range(GROUPS) if ends[g] < ends[g + 1]]


def gradients(p: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """The mean log loss of classes y (-1: none) after rows x, windows of one length, and its gradients.

    A class's probability is its group's times its own in the group, so a place costs GROUPS + WITHIN exponentials instead of CLASSES.
    Queries meet embeddings through wq wk', and wv is applied to averages of embeddings."""
    b, t = x.shape
    kind, row, look = p["embed"].dtype, x.ravel(), _LOOK[:t, :t]
    root = kind.type(1 / math.sqrt(DIM))
    wide = lambda z: z.reshape(b, t, -1)
    e = p["embed"].take(row, axis=0)
    e3 = wide(e)
    turned = np.ascontiguousarray(e3.transpose(0, 2, 1))
    meet = (p["wq"] * root) @ p["wk"].T
    q = e @ meet
    a = wide(q) @ turned
    small = _fits(a, float(np.abs(p["far"]).max()))
    a += np.append(p["far"], kind.type(-1e9)).take(look)
    if not small:
        a -= a.max(axis=-1, keepdims=True)
    np.exp(a, out=a)
    one = np.ones((t, 1), kind)
    a /= a @ one
    mean = (a @ e3).reshape(-1, DIM)
    h = mean @ p["wv"]
    h += e

    order, classes, parts = by_class(y.ravel())
    many = len(order)
    hs = np.ones((many, DIM + 1), kind)  # the last column takes the bias
    hs[:, :DIM] = h.take(order, axis=0)
    outer, inner = head_parts(p)
    place = _IN.take(classes)
    at = np.arange(0, many * WITHIN, WITHIN) + place
    at_group = np.arange(0, many * GROUPS, GROUPS) + (classes - place) // WITHIN
    groups, own = hs @ outer, np.empty((many, WITHIN), kind)
    for g, i, j in parts:
        np.matmul(hs[i:j], inner[g], out=own[i:j])
    meant = _below(own).ravel().take(at) + _below(groups).ravel().take(at_group)
    total, each = np.exp(groups, out=groups) @ np.ones(GROUPS, kind), np.exp(own, out=own) @ np.ones(WITHIN, kind)
    loss = float((np.log(total) + np.log(each) - meant).mean())
    share = kind.type(1 / many)
    groups *= (share / total)[:, None]
    own *= (share / each)[:, None]
    groups.ravel()[at_group] -= share
    own.ravel()[at] -= share
    dhs, g_inner = np.zeros((many + 1, DIM), kind), np.zeros_like(inner)  # the last is for places without a class
    back = np.ascontiguousarray(inner[:, :DIM].transpose(0, 2, 1))
    for g, i, j in parts:
        np.matmul(own[i:j], back[g], out=dhs[i:j])
        np.matmul(hs[i:j].T, own[i:j], out=g_inner[g])
    dhs[:many] += groups @ np.ascontiguousarray(outer[:DIM].T)
    g_head = np.hstack([g_inner.transpose(1, 0, 2).reshape(DIM + 1, CLASSES), hs.T @ groups])
    back_at = np.full(b * t, many)
    back_at[order] = np.arange(many)
    de = dhs.take(back_at, axis=0)

    g_wv, dmean = mean.T @ de, wide(de @ p["wv"].T)
    de += (a.transpose(0, 2, 1) @ dmean).reshape(-1, DIM)
    ds = dmean @ turned
    ds *= a
    a *= ds @ one
    ds -= a
    far = np.bincount(look.ravel(), np.ones(b, kind) @ ds.reshape(b, -1), SPAN + 1)[:SPAN]
    de += (ds.transpose(0, 2, 1) @ wide(q)).reshape(-1, DIM)
    dq = (ds @ e3).reshape(-1, DIM)
    de += dq @ meet.T
    g_meet = e.T @ dq * root
    embed = np.zeros_like(p["embed"])
    pair = np.result_type(kind, np.complex64)  # two cells are added at once
    np.add.at(embed.view(pair).ravel(), _PAIRS.take(row, axis=0).ravel(), de.view(pair).ravel())
    g = {"embed": embed, "head": g_head[:DIM], "bias": g_head[DIM], "far": far, "wq": g_meet @ p["wk"], "wk": g_meet.T @ p["wq"], "wv": g_wv}
    return loss, g


def schedule(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The batches of a round: all windows once."""
    return [(x[i : i + BATCH], y[i : i + BATCH]) for i in range(0, len(x), BATCH)]


def adam(p: Params, windows: Iterable[tuple[np.ndarray, np.ndarray]], rate: float, steps: int | None = None) -> Params:
    """A step for each of the windows' batches in order; steps is their number, where they are no list."""
    cuts = np.cumsum([x.size for x in p.values()])[:-1]
    all_ = np.concatenate([x.ravel() for x in p.values()])  # one array, of which p has views
    p = {k: part.reshape(x.shape) for (k, x), part in zip(p.items(), np.split(all_, cuts), strict=True)}
    m, v, g = (np.zeros_like(all_) for _ in range(3))
    room = np.empty(min(len(all_), ADAM_PART), all_.dtype)
    parts = [(*(z[i : i + ADAM_PART] for z in (all_, m, v, g)), room[: len(all_) - i]) for i in range(0, len(all_), ADAM_PART)]
    into = dict(zip(p, np.split(g, cuts), strict=True))
    steps = len(windows) if steps is None else steps
    for i, batch in enumerate(windows):
        for k, x in gradients(p, *batch)[1].items():
            into[k][:] = x.ravel()
        now = rate * min(1.0, (i + 1) / 10) * (1 - 0.9 * min(1.0, i / steps))
        now *= math.sqrt(1 - 0.99 ** (i + 1)) / (1 - 0.9 ** (i + 1))
        small = 1e-8 * math.sqrt(1 - 0.99 ** (i + 1))
        for q, first, second, change, w in parts:
            first *= 0.9
            first += np.multiply(change, 0.1, out=w)
            second *= 0.99
            change *= change
            change *= 0.01
            second += change
            np.sqrt(second, out=w)
            w += small
            np.divide(first, w, out=w)
            w *= now
            q -= w
    return p


def pack(p: Params) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in sorted(p))


def unpack(raw: bytes, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = np.frombuffer(raw, "<f4", like[k].size, at).reshape(like[k].shape).copy()
        at += like[k].size * 4
    return out


class Scorer:
    """Scores batches of documents by windows; tables by embedding row are made once."""

    def __init__(self, p: Params, shape: Shape) -> None:
        zero = np.zeros((1, DIM), np.float32)
        e = p["embed"]
        self.embed = np.hstack([np.vstack([e, zero]), np.zeros((len(e) + 1, 1), np.float32)])
        one = np.ones((len(e) + 1, 1), np.float32)
        one[-1] = -30000.0  # the pad's key: no query attends to it
        self.q = np.hstack([np.vstack([e @ p["wq"] / math.sqrt(DIM), zero]), np.ones_like(one)]).astype(np.float32)
        self.k = np.hstack([np.vstack([e @ p["wk"], zero]), np.where(one < 0, one, 0)]).astype(np.float32)
        self.v = np.hstack([np.vstack([e @ p["wv"], zero]), np.ones_like(one)]).astype(np.float32)  # the last column sums the weights
        age = (np.arange(SPAN - STEP, SPAN)[:, None] - np.arange(SPAN)[None, :])
        self.far = np.where(age >= 0, p["far"][np.maximum(age, 0)], np.float32(-30000)).astype(np.float32)
        (self.outer, self.inner), self.shape = head_parts(p), shape  # the biases go with the column of ones
        norm = lambda x, axis=1: float(np.sqrt((x * x).sum(axis=axis)).max())
        # where no score can overflow, none needs its row's maximum taken off
        self.small = norm(self.q[:, :-1]) * norm(self.k[:, :-1]) + float(np.abs(p["far"]).max()) < 60

    def score(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each document, whose ids come one document after another (the ends are added here)."""
        s, n = self.shape, counts + 1
        windows = -(-n // STEP)
        room = windows * STEP + SPAN - STEP
        begin = np.cumsum(room) - room + SPAN - STEP  # the end of the document before, which is the first input
        rows, goals = np.full(int(room.sum()), PAD, np.int64), np.full(int(room.sum()), -1, np.int64)
        rows[begin] = s.rows[s.end]
        at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))
        rows[at + 1] = s.rows[ids]
        goals[at] = ids
        goals[begin + counts] = s.end
        last = np.repeat(begin, room) + np.repeat(counts, room) < np.arange(len(rows))
        rows[last] = PAD
        starts = np.repeat(begin - (SPAN - STEP), windows) + STEP * (np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows))
        owner, out = np.repeat(np.arange(len(counts)), windows), np.zeros(len(counts))
        wide, late, most = np.arange(SPAN), SPAN - STEP, 128
        held = np.empty((most * STEP, WITHIN), np.float32)
        for i in range(0, len(starts), most):
            x = rows[starts[i : i + most, None] + wide]
            y, n = goals[starts[i : i + most, None] + wide[late:]].ravel(), len(x)
            keys, own = x.ravel(), x[:, late:].ravel()
            w = self.q.take(own, axis=0).reshape(n, STEP, -1) @ np.ascontiguousarray(self.k.take(keys, axis=0).reshape(n, SPAN, -1).transpose(0, 2, 1))
            w += self.far
            if not self.small:
                w -= w.max(axis=2, keepdims=True)
            np.exp(w, out=w)
            h = (w @ self.v.take(keys, axis=0).reshape(n, SPAN, -1)).reshape(n * STEP, -1)
            total = h[:, DIM:].copy()
            total[total == 0] = 1  # after a document's end there is nothing to attend to
            h /= total
            h += self.embed.take(own, axis=0)
            order, classes, parts = by_class(np.where(y < 0, -1, s.classes[y]))
            hs = h.take(order, axis=0)
            groups, own = hs @ self.outer, held[: len(order)]
            for g, j, k in parts:
                np.matmul(hs[j:k], self.inner[g], out=own[j:k])
            got = _below(own).ravel().take(np.arange(0, own.size, WITHIN) + classes % WITHIN)
            got += _below(groups).ravel().take(np.arange(0, groups.size, GROUPS) + classes // WITHIN)
            got -= np.log(np.exp(groups, out=groups) @ np.ones(GROUPS, np.float32))
            got -= np.log(np.exp(own, out=own) @ np.ones(WITHIN, np.float32))
            each = np.zeros(len(y))
            each[order] = got / math.log(10) + s.share[y[order]]
            out += np.bincount(owner[i : i + most], each.reshape(-1, STEP).sum(axis=1, dtype=np.float64), len(counts))
        return out

    def score_parts(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The same for documents between bounds, about PART_IDS ids at a time."""
        out, i = [], 0
        while i < len(bounds) - 1:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PART_IDS, side="right")) - 1)
            out.append(self.score(ids[bounds[i] : bounds[j]], np.diff(bounds[i : j + 1])))
            i = j
        return np.concatenate(out) if out else np.zeros(0)


_HOT: dict[str, Hot] = {}
on_change(_HOT.clear)


def _hot(name: str) -> Hot:
    if name not in _HOT:
        _HOT.clear()
        fs, local = split_path(name)
        with fs.open_input_file(local) as f:
            _HOT[name] = Hot.load(f.read())
    return _HOT[name]


def encode_words(words: pa.Array, hot: Hot, encoder: WordEncoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Subword ids of words in a row, how many each has, each word's place in hot (-1: none), and the words coded."""
    coded = words.dictionary_encode()
    unique = coded.dictionary
    place = pc.fill_null(pc.index_in(unique, value_set=hot.words), -1).to_numpy().astype(np.int64)
    cold = np.flatnonzero(place < 0)
    own, counts = encoder.encode(unique.take(pa.array(cold)))
    sizes = np.zeros(len(unique), np.int64)
    sizes[place >= 0] = np.diff(hot.starts)[place[place >= 0]]
    sizes[cold] = counts
    starts = np.zeros(len(unique), np.int64)
    starts[place >= 0] = hot.starts[place[place >= 0]]
    starts[cold] = len(hot.flat) + np.cumsum(sizes[cold]) - sizes[cold]
    flat = np.concatenate([hot.flat, own.astype(np.int32)])
    index = coded.indices.to_numpy()
    each = sizes[index]
    return gathered(flat, starts[index], each), each, place[index], coded


def tiles(ids: np.ndarray, counts: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Rows (int16) and classes (a byte, NO_CLASS past the end), (n, SPAN) each: windows side by side over each document, every id and
    end the goal of one place."""
    room = -(-(counts + 1) // SPAN) * SPAN
    begin = np.cumsum(room) - room
    x, y = np.full(int(room.sum()), INPUTS, np.int16), np.full(int(room.sum()), NO_CLASS, np.uint8)
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))
    x[begin], x[at + 1] = shape.rows[shape.end], shape.rows[ids]
    y[at], y[begin + counts] = shape.classes[ids], shape.classes[shape.end]
    return x.reshape(-1, SPAN), y.reshape(-1, SPAN)


def training_windows(docs: DataFrame, hot_name: str, tokenizer: str, shape: Shape) -> DataFrame:
    """windows: rows and classes, (n, SPAN) each, of all ids of every training document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, encoder = _hot(hot_name), WordEncoder.of(tokenizer)
        for b in sliced(batches, "text", 8 << 20):
            words, bounds = split_words(b.column(1))
            training = np.array([not held_out(d) for d in b.column(0).to_pylist()])
            if not training.any():
                continue
            sizes = np.diff(bounds)[training]
            ids, each, _, _ = encode_words(words.filter(pa.array(np.repeat(training, np.diff(bounds)))), hot, encoder)
            spots = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)])]
            x, y = tiles(ids, np.diff(spots), shape)
            order = np.random.default_rng(7).permutation(len(x))  # a step's windows come from many documents
            x, y = x[order], y[order]
            for i in range(0, len(x), PART_WINDOWS * BATCH_ROWS):
                yield packed(x[i : i + PART_WINDOWS * BATCH_ROWS], y[i : i + PART_WINDOWS * BATCH_ROWS])

    return docs.select("doc_id", "text").mapInArrow(run, "windows binary, n long")


def _arrays(raw: bytes | np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and classes (-1: none)."""
    x = np.frombuffer(raw, np.int16, n * SPAN).reshape(n, SPAN).astype(np.int64)
    y = np.frombuffer(raw, np.uint8, n * SPAN, 2 * n * SPAN).reshape(n, SPAN).astype(np.int64)
    y[y == NO_CLASS] = -1
    return x, y


def packed(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Rows of the table of training windows: of PART_WINDOWS windows each, and the rest in one."""
    full = len(x) // PART_WINDOWS * PART_WINDOWS
    sizes = np.full(-(-len(x) // PART_WINDOWS), PART_WINDOWS, np.int64)
    sizes[full // PART_WINDOWS :] = len(x) - full
    data = np.hstack([x[:full].view(np.uint8).reshape(-1, PART_WINDOWS * SPAN * 2), y[:full].reshape(-1, PART_WINDOWS * SPAN)]).tobytes()
    data += x[full:].tobytes() + y[full:].tobytes()
    offsets = np.concatenate([[0], np.cumsum(sizes * SPAN * 3)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), pa.array(sizes)], ["windows", "n"])


def joined(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows and classes (-1: none) of all windows of a batch of the table."""
    data, at = texts_of(b.column(0))
    n, xs, ys, i = b.column(1).to_numpy(), [], [], 0
    for j in [*np.flatnonzero(n != PART_WINDOWS).tolist(), len(n)]:
        full = data[at[i] : at[j]].reshape(-1, PART_WINDOWS * SPAN * 3)
        xs.append(np.ascontiguousarray(full[:, : PART_WINDOWS * SPAN * 2]).view(np.int16).reshape(-1, SPAN).astype(np.int64))
        ys.append(full[:, PART_WINDOWS * SPAN * 2 :].reshape(-1, SPAN).astype(np.int64))
        ys[-1][ys[-1] == NO_CLASS] = -1
        if j < len(n):
            x, y = _arrays(data[at[j] : at[j + 1]], n[j])
            xs.append(x)
            ys.append(y)
        i = j + 1
    return np.concatenate(xs), np.concatenate(ys)


def fit(windows: DataFrame, tasks: int) -> Params:
    """Bigram counts of all windows, then rounds of local training in so many tasks with averaged parameters."""
    spark = windows.sparkSession
    cells = (INPUTS + RARE) * CLASSES
    # neighbouring files and splits in a task, without a shuffle: a batch's windows come from many documents already
    dealt = windows.coalesce(tasks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, windows_seen = np.zeros(cells, np.int64), 0
        for b in batches:
            x, y = joined(b)
            total += np.bincount((x * CLASSES + y)[y >= 0], minlength=cells)
            windows_seen += len(x)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(total[at[i : i + 50_000]])], ["cell", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([windows_seen], pa.int64())], ["cell", "n"])

    bigrams, many = np.zeros(cells), 0
    for r in dealt.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():  # at most `cells` rows and one
        if r["cell"] < 0:
            many = r["n"]
        else:
            bigrams[r["cell"]] = r["n"]
    p = initial(bigrams.reshape(-1, CLASSES))
    if not bigrams.any():
        return p
    steps = max(1, -(-many // (tasks * BATCH)))  # of a task, on average: the rate falls over so many
    for k in range(ROUNDS):
        raw, rate = spark.sparkContext.broadcast(pack(p)), RATE / (1 + 2 * k)

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn_to("training")  # needs nothing that other tasks hold
            seen = [0]

            def stream() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for b in batches:
                    x, y = joined(b)
                    seen[0] += len(x)
                    yield from schedule(x, y)

            found = adam(unpack(raw.value, p), stream(), rate, steps)  # noqa: B023
            if seen[0]:
                yield pa.RecordBatch.from_arrays([pa.array([pack(found)], pa.binary()), pa.array([seen[0]], pa.int64())], ["params", "n"])

        total, weight = None, 0
        found = written(dealt.mapInArrow(train, "params binary, n long"), "params")  # all tasks at once
        for r in found.toLocalIterator():  # some tasks' parameters at a time
            part = np.frombuffer(r["params"], "<f4").astype(np.float64) * r["n"]
            total, weight = part if total is None else total + part, weight + r["n"]
        p = unpack((total / weight).astype("<f4").tobytes(), p)
    return p


def score_texts(docs: DataFrame, tokenizer: str | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row."""
    spark = docs.sparkSession
    ship(spark)
    tokenizer = tokenizer or default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = written(word_counts(docs), "words")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == END.decode(), F.col("n"))).alias("ends")).first()
    n_train, v_train, ends = total["n"] or 0, total["v"], total["ends"] or 0
    hot = choose_hot(counts, tokenizer, hot_words)
    hot_name = f"{scratch(spark, 'hot')}.bin"
    fs, local = split_path(hot_name)
    fs.create_dir(local.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(local, compression=None) as out:
        out.write(hot.dump())
    shape = corpus_shape(counts, tokenizer, ends, WordEncoder.of(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True))
    windows = written(training_windows(docs, hot_name, tokenizer, shape), "windows")
    made = windows.agg(F.sum("n")).first()[0] or 0
    params = pack(p := fit(windows, max(1, min(width(spark), made // (BATCH * TASK_STEPS)))))
    del hot
    _HOT.clear()
    sizes = {k: x.shape for k, x in p.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, encoder = _hot(hot_name), WordEncoder.of(tokenizer)
        scorer = Scorer(unpack(params, {k: np.empty(s, np.float32) for k, s in sizes.items()}), shape)
        logs = np.log10(own.counts + 1.0)
        row = TaskContext.get().partitionId() << 40
        for b in sliced(batches, "text", 5 << 20):
            words, bounds = split_words(b.column(1))
            ids, each, place, coded = encode_words(words, own, encoder)
            spots = np.concatenate([[0], np.cumsum(each)])
            n = np.diff(bounds)
            value = np.concatenate([[0.0], np.cumsum(np.where(place >= 0, logs[place], 0.0))]) if len(logs) else np.zeros(len(place) + 1)
            known = np.concatenate([[0], np.cumsum(place >= 0)])
            keys = b.column(0).to_pylist()
            at = row + np.arange(len(n))
            row += len(n)
            none = pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.int64())
            scores = scorer.score_parts(ids, spots[bounds])
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0), pa.array([held_out(d) for d in keys]), pa.array(n + 1), pa.array(known[bounds[1:]] - known[bounds[:-1]]), pa.array(value[bounds[1:]] - value[bounds[:-1]]), pa.array(scores), *none], names)
            del ids, value, known, scores
            cold = np.flatnonzero(place < 0)
            if len(cold):
                width_ = len(coded.dictionary)
                pair, tf = np.unique(np.repeat(np.arange(len(n)), n)[cold] * width_ + coded.indices.to_numpy()[cold], return_counts=True)
                for i in range(0, len(pair), 100_000):
                    part = pair[i : i + 100_000]
                    void = [pa.nulls(len(part), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(at[part // width_]), *void, coded.dictionary.take(pa.array(part % width_)), pa.array(tf[i : i + 100_000])], names)

    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "word", "tf"]
    rows = written(docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, word string, tf long"), "scored")
    rest = rows.where("word is not null").select("row", "word", "tf").join(counts, "word")
    rest = rest.groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("n") + F.lit(1.0))).alias("added"))
    own = rows.where("word is null").drop("word", "tf")
    log_d = math.log10(n_train + v_train + 1)
    end_value, end_known = math.log10(ends + 1), int(ends > 0)
    return own.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("added", F.lit(0.0)) + F.lit(end_value) - F.col("n_tokens") * F.lit(log_d)).alias("base_score"),
        "score",
    )


def brute_base(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score by definition, for tests."""
    from collections import Counter

    seen: Counter = Counter()
    texts = [((t or "").encode().lower().split() + [END]) for _, t in rows]
    for (d, _), w in zip(rows, texts, strict=True):
        if not held_out(d):
            seen.update(w)
    n, v = sum(seen.values()), len(seen)
    return [(d, held_out(d), len(w), sum(seen[x] > 0 for x in w), n, math.fsum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w)) for (d, _), w in zip(rows, texts, strict=True)]
