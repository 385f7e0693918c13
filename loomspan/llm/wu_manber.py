"""Benchmark decontamination: Wu-Manber multi-pattern search with words as the symbols.

Every window of an item is a pattern. For each pattern length there is a table of shifts over blocks of two neighbouring
words: how far a search may move on without passing an occurrence. Where the shift is zero, the block's suffix bucket names
the patterns that may end there, their first words and then all words are compared. Texts are cut into short runs of
positions that move on together, so the loop is over moves and not over words.

The items are compiled in blocks of at most ITEM_BLOCK_BYTES of text, kept in the shared folder and read by the tasks; a
larger benchmark only means more blocks, each searched in all rows.

Defined cases: a null or empty text, or one without words, has no words and no hit; null items and items without words
match nothing; an item shorter than the window is one window; repeated items count once by item_id; a null item_id is
written "null"; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, ship, sliced, split_path, texts_of

WINDOW = 13
#: Item text compiled together, and so held by a worker.
ITEM_BLOCK_BYTES = 32 << 20
#: Window positions that a run covers.
RUN = 192
#: A document is contaminated if at least 1 of so many words is hit.
SHARE = 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Patterns:
    """The windows of some items, ready for the search. Plain arrays and lists, so that it pickles."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        at = {x: k for k, x in enumerate(self.items)}
        found: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                found[m][tuple(ids[i : i + m])].add(at[item])
        self.tables = {m: self._tables(m, by) for m, by in sorted(found.items())}

    def _tables(self, m: int, by: dict[tuple[int, ...], set[int]]) -> dict:
        patterns = np.array(list(by), np.int64).reshape(-1, m)
        owners = [sorted(x) for x in by.values()]
        block = min(2, m)
        bits = max(16, int(np.ceil(np.log2(len(patterns) * m + 1))) + 3)
        shift = np.full(1 << bits, m - block + 1, np.int64)
        for j in range(block - 1, m):  # the block that ends at word j
            np.minimum.at(shift, self.hashed(patterns[:, j - 1] if block == 2 else None, patterns[:, j], bits), m - 1 - j)
        last = self.hashed(patterns[:, -2] if block == 2 else None, patterns[:, -1], bits)
        order = np.argsort(last, kind="stable")
        return {"patterns": patterns[order], "owners": [owners[i] for i in order], "shift": shift, "suffix": last[order], "bits": bits, "block": block}

    @staticmethod
    def hashed(a: np.ndarray | None, b: np.ndarray, bits: int) -> np.ndarray:
        h = b.astype(np.uint64) if a is None else a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)

    def word_set(self) -> pa.Array:
        return pa.array(list(self.vocabulary), pa.binary())


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in a row, and the n+1 word offsets of the texts."""
    data, offsets = texts_of(column)
    lo, hi = int(offsets[0]), int(offsets[-1])
    folded = data[lo:hi].tobytes().translate(_FOLD)
    texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer((offsets - lo).astype(np.int64).tobytes()), pa.py_buffer(folded)])
    lists = pc.ascii_split_whitespace(texts)
    words, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    return words.filter(pa.array(real)).cast(pa.large_binary()), np.concatenate([[0], np.cumsum(real)])[bounds]


def search(ids: np.ndarray, bounds: np.ndarray, table: dict, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of occurrences (positions in ids) and the patterns that end there. bounds: where the texts begin and end."""
    first, last = bounds[:-1] + m - 1, bounds[1:]
    runs = np.maximum(0, -(-(last - first) // RUN))
    which = np.repeat(np.arange(len(runs)), runs)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs)
    pos = first[which] + nth * RUN
    stop = np.minimum(pos + RUN, last[which])
    shift, bits, two = table["shift"], table["bits"], table["block"] == 2
    ends, keys = [], []
    while len(pos):
        h = Patterns.hashed(ids[pos - 1] if two else None, ids[pos], bits)
        move = shift[h]
        if (at := np.flatnonzero(move == 0)).size:
            ends.append(pos[at])
            keys.append(h[at])
        pos = pos + np.maximum(move, 1)
        if not (on := pos < stop).all():
            pos, stop = pos[on], stop[on]
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends, keys = np.concatenate(ends), np.concatenate(keys)
    lo, hi = np.searchsorted(table["suffix"], keys), np.searchsorted(table["suffix"], keys, side="right")
    ends, n = np.repeat(ends, hi - lo), hi - lo
    of = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    for k in range(m):  # first words first: most that agree in the suffix's hash differ there
        same = ids[ends - m + 1 + k] == table["patterns"][of, k]
        ends, of = ends[same], of[same]
        if not len(ends):
            break
    return ends, of


def occurrences(column: pa.Array, blocks: list[Patterns]) -> tuple[np.ndarray, np.ndarray, list[list[str]], np.ndarray]:
    """For each text: words, words hit, items found (sorted); and for each word of all texts whether it is hit."""
    words, bounds = split_words(column)
    cover = np.zeros(len(words) + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(len(bounds) - 1)]
    for block in blocks:
        ids = pc.fill_null(pc.index_in(words, value_set=pa.array(list(block.vocabulary), pa.large_binary())), -1).to_numpy().astype(np.int64)
        for m, table in block.tables.items():
            ends, of = search(ids, bounds, table, m)
            np.add.at(cover, ends - m + 1, 1)
            np.add.at(cover, ends + 1, -1)
            pairs = np.unique((np.searchsorted(bounds, ends, side="right") - 1) * len(table["patterns"]) + of)
            for d, p in zip((pairs // len(table["patterns"])).tolist(), (pairs % len(table["patterns"])).tolist(), strict=True):
                found[d].update(block.items[i] for i in table["owners"][p])
    hit = np.cumsum(cover)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    return np.diff(bounds), np.diff(total[bounds]), [sorted(x) for x in found], hit


def compile_items(items: DataFrame, window: int = WINDOW, block_bytes: int = ITEM_BLOCK_BYTES) -> list[str]:
    """Compiled blocks of items (item_id, text) in the shared folder; one block of text is held at a time."""
    spark = items.sparkSession
    path, names, held, size = scratch(spark, "patterns"), [], [], 0

    def put() -> None:
        names.append(f"{path}/block-{len(names):05d}.pickle")
        fs, local = split_path(names[-1])
        fs.create_dir(local.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(local, compression=None) as out:
            out.write(pickle.dumps(Patterns(held, window)))
        held.clear()

    for r in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        held.append((r["i"], r["t"]))
        size += len(r["t"] or "")
        if size >= block_bytes:
            put()
            size = 0
    if held:
        put()
    return names


_BLOCKS: dict[str, Patterns] = {}


def _load(name: str) -> Patterns:
    if name not in _BLOCKS:
        _BLOCKS.clear()  # one block at a time
        fs, local = split_path(name)
        with fs.open_input_file(local) as f:
            _BLOCKS[name] = pickle.loads(f.read())
    return _BLOCKS[name]


class _Lazy:
    def __init__(self, names: list[str]) -> None:
        self.names = names

    def __iter__(self) -> Iterator[Patterns]:
        return map(_load, self.names)


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit and item_ids (those with occurring windows, sorted as strings) for each document."""
    ship(docs.sparkSession)
    names = compile_items(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 4 << 20):
            n, hit, found, _ = occurrences(b.column(1), _Lazy(names))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "item_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_hit long, item_ids array<string>")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = find_items(docs, items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(SHARE) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    ship(docs.sparkSession)
    names = compile_items(items)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 4 << 20):
            n, hit, _, _ = occurrences(b.column(at), _Lazy(names))
            yield b.filter(pa.array(~((hit > 0) & (SHARE * hit >= n))))

    return docs.mapInArrow(run, docs.schema)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same by definition, for tests."""
    rows = []
    windows = []
    for item, text in items:
        w = words_of(text)
        m = min(window, len(w))
        windows += [("null" if item is None else str(item), tuple(w[i : i + m])) for i in range(len(w) - m + 1 if m else 0)]
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    found.add(item)
        rows.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and SHARE * len(hit) >= len(w)))
    return rows
