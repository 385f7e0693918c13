"""Token-id output: raw id shards in key order, and a minimal perfect hash index from keys to shard offsets.

Shards hold nothing but ids (little-endian, 16 bits where the vocabulary fits, else 32), documents back to back in
ascending key order. The index is dealt into parts by a key's hash; each part is a minimal perfect hash made of levels of
bit arrays (a key takes the first level where no other key shares its bit, its slot is the rank of that bit), and per slot
a 32-bit fingerprint, shard, offset and length. A lookup reads one part, tests about two bits, compares the fingerprint and
then reads one range of one shard.

Defined cases: a null text is empty (its ids are the end id alone); a null key sorts first and is a key like others;
repeated keys are kept apart by an ordinal that follows the text's order; an empty table gives no shard and no row; other
columns are ignored. A key that was never written is answered by no row unless its fingerprint collides (2**-32).
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, on_change, scratch, ship, sliced, split_path, width

#: Pieces whose ids a worker remembers in arrays (about 30 bytes each); beyond it the older half goes,
#: which costs time only. New ones gather in a dict first.
WORD_MEMORY = 1_200_000
YOUNG_WORDS = 120_000
#: Keys per index part, about.
PART_KEYS = 1 << 16
#: Shard bytes read at once when rows are read back.
READ_BYTES = 4 << 20

ENTRY = "doc_id long, ord int, shard int, path string, offset long, n_tokens long"

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of whole texts by the tokenizers library, each distinct white-space-free piece encoded once.

    ASCII white space ends a piece in this vocabulary's normaliser and pre-tokeniser, and neither looks across it, so
    the ids of a text are the ids of its pieces in a row. The pre-tokeniser always cuts between a letter and a stop, and
    the normaliser lower-cases, so pieces are cut and lower-cased first (not where a special token's string may stand:
    those are found in the text as it is). Pieces are told apart and looked up column-wise.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.young: dict[str, bytes] = {}
        self.words = pa.array([], pa.string())
        self.flat, self.starts = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
            on_change(_encoders[path].forget)
        return _encoders[path]

    def _settle(self) -> None:
        """Move the young pieces to the arrays, whose older half goes when there are too many."""
        words, flat, starts = self.words, self.flat, self.starts
        if len(words) + len(self.young) > WORD_MEMORY:
            cut = len(words) // 2
            words, flat, starts = pa.concat_arrays([words[cut:]]), flat[starts[cut] :], starts[cut:] - starts[cut]
        sizes = np.fromiter(map(len, self.young.values()), np.int64, len(self.young)) // self.dtype.itemsize
        self.words = pa.concat_arrays([words, pa.array(list(self.young), pa.string())])
        self.flat = np.concatenate([flat, np.frombuffer(b"".join(self.young.values()), self.dtype)])
        self.starts = np.concatenate([starts, starts[-1] + np.cumsum(sizes)])
        self.young = {}

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces in a row, and how many each has."""
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        rest = np.flatnonzero(place < 0)
        young, kind = self.young, "H" if self.dtype.itemsize == 2 else "I"
        names = words.take(pa.array(rest)).to_pylist()
        new = [w for w in names if w not in young]
        for i in range(0, len(new), 5_000):
            part = new[i : i + 5_000]
            got = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            young.update((w, array(kind, e.ids).tobytes()) for w, e in zip(part, got, strict=True))
        blobs = [young[w] for w in names]
        sizes, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        own = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.dtype.itemsize
        old = np.flatnonzero(place >= 0)
        sizes[rest], starts[rest] = own, len(self.flat) + np.cumsum(own) - own
        sizes[old], starts[old] = np.diff(self.starts)[place[old]], self.starts[place[old]]
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(blobs), self.dtype)])
        if len(young) > YOUNG_WORDS:
            self._settle()
        return gathered(flat, starts, sizes), sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has; nulls are empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.fill_null("")
        if not pc.any(pc.match_substring(column, "<|")).as_py():
            column = pc.replace_substring_regex(pc.ascii_lower(column), "([a-z])([.,;:!?])", r"\1 \2")
        lists = pc.ascii_split_whitespace(column)
        pieces = lists.flatten().dictionary_encode()
        flat, sizes = self.ids_of(pieces.dictionary)
        index = pieces.indices.to_numpy()
        each = sizes[index]
        ids = gathered(flat, (np.cumsum(sizes) - sizes)[index], each)
        bounds = lists.offsets.to_numpy().astype(np.int64) - (lists.offsets[0].as_py() if len(lists) else 0)
        return ids, np.diff(np.concatenate([[0], np.cumsum(each)])[bounds])


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ranges of flat one after another."""
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def _write_shards(path: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        shard, at, name, out = TaskContext.get().partitionId(), 0, f"{path}/ids/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids", None
        last, ordinal = (), 0
        fs, local = split_path(name)
        for b in sliced(batches, "text", 8 << 20):
            if out is None:
                fs.create_dir(local.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(local, compression=None)
            ids, counts = encoder.encode(b.column(1))
            out.write(np.insert(ids, np.cumsum(counts), end_id).tobytes())
            counts = counts + 1
            rows = []
            for key in b.column(0).to_pylist():
                ordinal = ordinal + 1 if last == (key,) else 0
                last = (key,)
                rows.append(ordinal)
            n = b.num_rows
            offsets = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array([name] * n), pa.array(offsets, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "ord", "shard", "path", "offset", "n_tokens"])
        if out is not None:
            out.close()

    return run


@dataclass
class TokenStore:
    """Where the shards and the index are. bases: path and ids before it, by shard number (one entry a shard)."""

    path: str
    tokenizer: str
    bases: dict[int, tuple[str, int]]
    parts: int


def hashed(keys: DataFrame) -> DataFrame:
    """Adds two independent 64-bit hashes of a key, which is doc_id (null is a value) and its ordinal."""
    key = (F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("ord").cast("string"))
    return keys.withColumns({"h1": F.xxhash64(*key), "h2": F.xxhash64(F.lit("fingerprint"), *key)})


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None, shards: int | None = None) -> TokenStore:
    """Encode docs (doc_id, text) into shards in ascending doc_id order and index them."""
    spark = docs.sparkSession
    ship(spark)
    path = path or scratch(spark, "tokens")
    entries = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(shards or width(spark), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .mapInArrow(_write_shards(path, tokenizer, end_id), ENTRY)
    )
    entries.write.parquet(f"{path}/entries")
    entries = spark.read.schema(ENTRY).parquet(f"{path}/entries")
    per_shard = entries.groupBy("shard", "path").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()  # one row a shard
    bases, at = {}, 0
    for r in sorted(per_shard, key=lambda r: r["shard"]):
        bases[r["shard"]] = (r["path"], at)
        at += r["n"]
    parts = max(1, -(-sum(r["docs"] for r in per_shard) // PART_KEYS))
    keyed = hashed(entries.select("doc_id", "ord", "shard", "offset", "n_tokens")).withColumn("part", F.pmod(F.col("h1"), F.lit(parts)).cast("int")).drop("doc_id", "ord")
    keyed.repartition(min(parts, width(spark)), "part").sortWithinPartitions("part").mapInArrow(_write_index(path), "part int, keys long, levels int").write.parquet(f"{path}/parts")
    return TokenStore(path, tokenizer, bases, parts)


def by_run(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[object, pa.Table]]:
    """Rows with equal values of a column that come one after another, as a table each."""
    held: list[pa.RecordBatch] = []
    value = None
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(b.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and v[i] != value:
                yield value, pa.Table.from_batches(held)
                held = []
            value = v[i]
            held.append(b.slice(i, j - i))
    if held:
        yield value, pa.Table.from_batches(held)


def _bit(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix64(h1 ^ mix64(h2 + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1))) % np.uint64(bits)).astype(np.int64)


def build_mph(h1: np.ndarray, h2: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels (one bool array each) and the slot of every key: a bijection from the keys onto 0..n-1."""
    if len(set(zip(h1.tolist(), h2.tolist(), strict=True))) != len(h1):
        raise ValueError("two keys share both hashes, or a key was given twice")
    left, levels, slot, rank = np.arange(len(h1)), [], np.zeros(len(h1), np.int64), 0
    while len(left):
        bits = max(64, 2 * len(left))
        at = _bit(h1[left], h2[left], len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        got = alone[at]
        slot[left[got]] = rank + np.cumsum(alone)[at[got]] - 1
        rank += int(got.sum())
        levels.append(alone)
        left = left[~got]
    return levels, slot


def find_slots(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Each key's slot, -1 where no level has its bit. A key that isn't in the index may get any slot."""
    slot, left, rank = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for k, bits in enumerate(levels):
        at = _bit(h1[left], h2[left], k, len(bits))
        got = bits[at]
        slot[left[got]] = rank + np.cumsum(bits)[at[got]] - 1
        rank += int(bits.sum())
        left = left[~got]
    return slot


def _part_name(path: str, part: int) -> str:
    return f"{path}/index/part-{part:08d}.mph"


def _write_index(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in by_run(batches, "part"):
            c = {k: t[k].to_numpy() for k in ("h1", "h2", "shard", "offset", "n_tokens")}
            h1, h2 = c["h1"].astype(np.int64).view(np.uint64), c["h2"].astype(np.int64).view(np.uint64)
            levels, slot = build_mph(h1, h2)
            order = np.argsort(slot)
            fs, name = split_path(_part_name(path, int(part)))
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            own = f"{name}.{uuid.uuid4().hex}"  # a repeated task writes the same bytes again, so the last move may win
            with fs.open_output_stream(own) as out:
                out.write(np.array([len(h1), len(levels), *(len(x) for x in levels)], "<i8").tobytes())
                for x in levels:
                    out.write(np.packbits(x, bitorder="little").tobytes())
                for x, kind in ((h2 & np.uint64(0xFFFFFFFF), "<u4"), (c["shard"], "<u4"), (c["offset"], "<u8"), (c["n_tokens"], "<u8")):
                    out.write(x[order].astype(kind).tobytes())
            fs.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int32()), pa.array([len(h1)], pa.int64()), pa.array([len(levels)], pa.int32())], ["part", "keys", "levels"])

    return run


def read_part(path: str, part: int) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    fs, name = split_path(_part_name(path, part))
    with fs.open_input_file(name) as f:
        raw = f.read()
    n, k = np.frombuffer(raw, "<i8", 2).tolist()
    sizes = np.frombuffer(raw, "<i8", k, 16).tolist()
    at, levels, slots = 16 + 8 * k, [], {}
    for s in sizes:
        levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-s // 8), at), count=s, bitorder="little").astype(bool))
        at += -(-s // 8)
    for x, kind in (("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n_tokens", "<u8")):
        slots[x] = np.frombuffer(raw, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return levels, slots


def _find(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in by_run(batches, "part"):
            h1, h2 = (t[k].to_numpy().astype(np.int64).view(np.uint64) for k in ("h1", "h2"))
            levels, slots = read_part(path, int(part))
            slot = find_slots(levels, h1, h2)
            hit = slot >= 0
            hit[hit] = slots["fingerprint"][slot[hit]] == (h2[hit] & np.uint64(0xFFFFFFFF))
            t, slot = t.filter(pa.array(hit)), slot[hit]
            yield from pa.Table.from_arrays([t["doc_id"], t["ord"], pa.array(slots["shard"][slot].astype(np.int32)), pa.array(slots["offset"][slot].astype(np.int64)), pa.array(slots["n_tokens"][slot].astype(np.int64))], ["doc_id", "ord", "shard", "offset", "n_tokens"]).to_batches(max_chunksize=20_000)

    return run


def locate(store: TokenStore, keys: DataFrame) -> DataFrame:
    """keys (doc_id, ord) through the index: where each one's ids are. Keys that aren't there give no row."""
    at = hashed(keys.select("doc_id", "ord")).withColumn("part", F.pmod(F.col("h1"), F.lit(store.parts)).cast("int"))
    at = at.repartition(min(store.parts, width(keys.sparkSession)), "part").sortWithinPartitions("part")
    return at.mapInArrow(_find(store.path), "doc_id long, ord int, shard int, offset long, n_tokens long")


def _read(bases: dict[int, tuple[str, int]], item: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, t in by_run(batches, "shard"):
            name, base = bases[int(shard)]
            fs, local = split_path(name)
            offsets, counts, held, at = t["offset"].to_numpy(), t["n_tokens"].to_numpy(), b"", 0
            keys, ords = t["doc_id"].to_pylist(), t["ord"].to_pylist()
            with fs.open_input_file(local) as f:
                i = 0
                while i < len(offsets):
                    j, crcs, ids = i, [], []
                    while j < len(offsets) and j - i < 5_000:
                        a, z = int(offsets[j]) * item, int(offsets[j] + counts[j]) * item
                        if not (at <= a and z <= at + len(held)):
                            f.seek(a)
                            at, held = a, f.read(max(READ_BYTES, z - a))
                        own = np.frombuffer(held, f"<u{item}", int(counts[j]), a - at).astype("<u4")
                        crcs.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            ids.append(own)
                        j += 1
                    columns = [pa.array(keys[i:j], pa.int64()), pa.array(ords[i:j], pa.int32()), pa.array(offsets[i:j] + base, pa.int64()), pa.array(counts[i:j], pa.int64()), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int64()))] if with_ids else [])], ["doc_id", "ord", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])
                    i = j

    return run


def read_back(store: TokenStore, keys: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per key: start, n_tokens, crc32 of its ids (and the ids), found by the index and read from the shards."""
    spark = keys.sparkSession
    item = WordEncoder.of(store.tokenizer).dtype.itemsize
    found = locate(store, keys).repartition(width(spark), "shard").sortWithinPartitions("shard", "offset")
    return found.mapInArrow(_read(store.bases, item, with_ids), "doc_id long, ord int, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def written_keys(store: TokenStore, spark: SparkSession) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(f"{store.path}/entries").select("doc_id", "ord")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_output(docs: DataFrame) -> DataFrame:
    """All documents written and read back by key: doc_id, start, n_tokens, ids_crc32, copy (the key's ordinal)."""
    store = write_store(docs, default_tokenizer())
    return read_back(store, written_keys(store, docs.sparkSession)).select("doc_id", "start", "n_tokens", "ids_crc32", F.col("ord").alias("copy"))
