"""Token ids in a compact binary file: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Format. `ranks` has one row per id that occurs: (id, rank), rank 0 being the most frequent over all documents, ties by id. `blocks` has rows
(shard, block, start, doc_ids, lengths, n, control, data); shards, then blocks, follow ascending doc_id. A block holds the ids of whole documents,
one rank after another: its little-endian bytes without leading zero bytes (1 to 4 of them) are appended to `data`, and its
number of bytes less one fills two bits of `control`, four ranks to a byte, lowest bits first; each document begins a new control byte. `start` counts the ids of the shard before the block.
Both are Parquet, so that any store Spark reads and its commit protocol will do.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, discard, lean, materialize, parts_of, word_spans

#: Distinct units that a worker remembers with their ids. Beyond that it forgets those that only one slice had, or all if few are left to forget.
REMEMBERED = 400_000
#: Units joined to one text for the tokenizer, and such texts given to it at once.
JOINED, TEXTS = 256, 16
#: Ids in a block, unless one document has more.
BLOCK_IDS = 1 << 19
_SEPARATOR = "\x00"
_LETTER = ((np.arange(256) >= 0x61) & (np.arange(256) <= 0x7A)) | ((np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A))
#: 0 white space, 1 ASCII letter, 2 other ASCII, 3 byte of a non-ASCII character.
_CLASS = np.where(~NOT_SPACE, 0, np.where(_LETTER, 1, np.where(np.arange(256) >= 0x80, 3, 2))).astype(np.uint8)
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def _units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of pieces that the tokenizer handles apart from each other: words, cut between an ASCII letter and any other
    ASCII character, where its pattern always ends a piece. A word with an apostrophe (contractions) or `<|` (special tokens) stays whole."""
    starts, ends, of = word_spans(raw, offsets, NOT_SPACE)
    if not len(starts):
        return starts, ends, of
    kind = _CLASS[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = ((kind[1:] == 1) & (kind[:-1] == 2)) | ((kind[1:] == 2) & (kind[:-1] == 1))
    glue = raw == 0x27
    glue[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
    held = np.zeros(len(starts), bool)
    held[np.searchsorted(starts, np.flatnonzero(glue), "right") - 1] = True
    cuts = np.flatnonzero(cut)
    cuts = cuts[~held[np.searchsorted(starts, cuts, "right") - 1]]
    first = np.sort(np.concatenate((starts, cuts)))  # a cut lies within a word, so never at a start
    last = np.sort(np.concatenate((ends, cuts)))
    return first, last, np.searchsorted(offsets, first, "right") - 1


class Encoder:
    """Ids of whole texts, the same as the tokenizer gives for each text. It is asked for each distinct unit of a worker's texts, many units joined
    by a separator that has a token of its own, and the texts are put together with numpy."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        found = self.tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids
        self.separator = found[0] if len(found) == 1 else None
        self._keep(np.zeros(0, bool))

    def _keep(self, mask: np.ndarray) -> None:
        """Forgets the known units but those of the mask."""
        if not len(mask):
            self.known = pa.array([], pa.large_string())
            self.at, self.flat, self.slices = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int32)
            return
        size = np.diff(self.at)
        self.known, self.flat, self.slices = self.known.filter(pa.array(mask)), self.flat[np.repeat(mask, size)], np.zeros(int(mask.sum()), np.int32)
        self.at = np.concatenate(([0], np.cumsum(size[mask])))

    def _ids_of(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of the units in runs, and the number of ids of each unit in runs."""
        ids, sizes = [], []
        if self.separator is None or any(_SEPARATOR in u for u in units):
            for u in units:
                ids.append(np.array(self.tokenizer.encode(u, add_special_tokens=False).ids, np.uint32))
                sizes.append(np.array([len(ids[-1])]))
            return ids, sizes
        texts = [f" {_SEPARATOR} ".join(units[i : i + JOINED]) for i in range(0, len(units), JOINED)]
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            found = np.array(e.ids, np.uint32)
            marks = np.flatnonzero(found == self.separator)
            sizes.append(np.diff(marks, prepend=-1, append=len(found)) - 1)
            ids.append(np.delete(found, marks))
        return ids, sizes

    def _learn(self, fresh: pa.Array) -> None:
        ids, sizes = [self.flat], []
        for i in range(0, len(fresh), JOINED * TEXTS):
            more = self._ids_of(fresh.slice(i, JOINED * TEXTS).to_pylist())
            ids += more[0]
            sizes += more[1]
        sizes = np.concatenate(sizes)
        assert len(sizes) == len(fresh)
        self.flat, self.known = np.concatenate(ids), pa.concat_arrays([self.known, fresh])
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))
        self.slices = np.concatenate((self.slices, np.zeros(len(fresh), np.int32)))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (raw, offsets: see text_bytes), and the number of ids of each text."""
        starts, ends, of = _units(raw, offsets)
        lengths = ends - starts
        inside = NOT_SPACE[raw]
        data = LOWER[raw[inside]]
        special = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)) if len(raw) else np.zeros(0, np.int64)
        if len(special):  # special tokens are matched before lower-casing
            held = np.zeros(len(starts), bool)
            held[np.searchsorted(starts, special, "right") - 1] = True
            data = np.where(np.repeat(held, lengths), raw[inside], data)
        units = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(lengths)))), pa.py_buffer(np.ascontiguousarray(data))])
        coded = units.dictionary_encode()
        words = coded.dictionary
        entry = pc.index_in(words, value_set=self.known)
        missing = entry.is_null()
        if entry.null_count:
            if len(self.known) + entry.null_count > REMEMBERED:
                often = self.slices > 1
                self._keep(often if 2 * often.sum() < REMEMBERED else np.zeros(0, bool))
                entry = pc.index_in(words, value_set=self.known)
                missing = entry.is_null()
            before = len(self.known)
            self._learn(words.filter(missing))
            new = missing.to_numpy(zero_copy_only=False)
            entry = entry.fill_null(0).to_numpy().copy()
            entry[new] = np.arange(before, before + int(new.sum()))
        else:
            entry = entry.to_numpy(zero_copy_only=False).astype(np.int32)
        self.slices[entry] += 1
        first, size = self.at[entry], np.diff(self.at)[entry].astype(np.int32)
        index = coded.indices.to_numpy() if len(words) else np.zeros(0, np.int32)
        count = size[index]
        total = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        place = np.repeat((first[index] - total[:-1]).astype(np.int32), count)
        place += np.arange(total[-1], dtype=np.int32)
        return self.flat[place], np.bincount(of, weights=count, minlength=len(offsets) - 1).astype(np.int64)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _with_end(ids: np.ndarray, count: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(count), end_id), count + 1


RAW = "doc_ids array<long>, lengths array<long>, ids binary"
CODED = "shard int, doc_id long, n long, control binary, data binary"


@lean
def _tokenize(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """A row per slice of texts: its ids by byte planes, squeezed."""
    squeeze = zstandard.ZstdCompressor(level=1)
    longs = pa.list_(pa.int64())
    held: list[np.ndarray] = []  # ids of the blocks so far of one long text
    for batch in batches:
        for part, raw, offsets, first, last in parts_of(batch, NOT_SPACE):
            ids, count = encoder(path).encode(raw, offsets)
            if not (first and last):
                held = [ids] if first else [*held, ids]
                if not last:
                    continue
                ids = np.concatenate(held)
                count, held = np.array([len(ids)]), []
            ids, count = _with_end(ids, count, end_id)
            planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
            yield pa.record_batch({"doc_ids": pa.array([part.column("doc_id").to_pylist()], longs), "lengths": pa.array([count], longs), "ids": pa.array([squeeze.compress(planes.tobytes())], pa.binary())})


def _planes(squeezed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(squeezed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        for squeezed in batch.column("ids"):
            found = np.bincount(_planes(squeezed.as_py()), minlength=len(total))
            found[: len(total)] += total
            total = found
    ids = np.flatnonzero(total)
    yield pa.record_batch({"id": pa.array(ids.astype(np.int32)), "n": pa.array(total[ids])})


def _quads(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes of each document, and the place of each rank among all two-bit codes."""
    quads = -(-lengths // 4)
    first = 4 * (np.cumsum(quads) - quads)
    return quads, np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def pack(ranks: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """control and data of the ranks of documents of these lengths, and where each document's part of them ends."""
    r = ranks.astype("<u4")
    size = (r >= 1 << 8).astype(np.uint8) + (r >= 1 << 16) + (r >= 1 << 24)
    quads, place = _quads(lengths)
    codes = np.zeros((int(quads.sum()), 4), np.uint8)
    codes.ravel()[place] = size
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    ends = np.cumsum(np.append(0, size.astype(np.int64) + 1))[np.cumsum(lengths)]
    return control.astype(np.uint8).tobytes(), r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]].tobytes(), np.cumsum(quads), ends


def unpack(control: bytes, data: bytes, lengths: np.ndarray) -> np.ndarray:
    """The ranks of pack()."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[_quads(lengths)[1]]
    out = np.zeros((len(size), 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


@lean
def _encode(batches: Iterator[pa.RecordBatch], rank_of: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per document: its shard and its packed ranks."""
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.array(row["lengths"], np.int64)
            control, data, c, d = pack(rank_of[_planes(row["ids"])], lengths)
            doc = pa.array(row["doc_ids"], pa.int64())
            shard = np.searchsorted(bounds, doc.fill_null(np.iinfo(np.int64).min).to_numpy(), "left")
            parts = [pa.array([x[a:b] for a, b in zip([0, *e[:-1].tolist()], e.tolist(), strict=True)], pa.binary()) for x, e in ((control, c), (data, d))]
            yield pa.record_batch([pa.array(shard.astype(np.int32)), doc, pa.array(lengths), *parts], names=["shard", "doc_id", "n", "control", "data"])


BLOCKS = "shard int, block int, start long, doc_ids array<long>, lengths array<long>, n long, control binary, data binary"


@lean
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one shard after the other, sorted, to blocks."""
    shard, block, start = -1, 0, 0
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        row = [[shard], [block], [start], [[x[0] for x in held]], [[x[1] for x in held]], [size], [b"".join(x[2] for x in held)], [b"".join(x[3] for x in held)]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    size = 0
    for batch in batches:
        for s, *row in zip(*(batch.column(k).to_pylist() for k in ("shard", "doc_id", "n", "control", "data")), strict=True):
            if held and (s != shard or size + row[1] > BLOCK_IDS):
                yield out()
                block, start, held, size = block + 1, start + size, [], 0
            if s != shard:
                shard, block, start = s, 0, 0
            held.append(tuple(row))
            size += row[1]
    if held:
        yield out()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, shard_ids: int = 16_000_000) -> None:
    """Writes the ids of docs(doc_id, text), `end_id` after each document, below path.

    A null or empty text has the end id only. Rows with the same doc_id follow each other, shorter ones first; rows without doc_id come first of all. Other columns are ignored.
    The texts are tokenized once, into a table of the shared folder. Its ids are counted over all documents, the counts (one per id of the vocabulary) are ranked, and a second pass encodes. Shards are cut at quantiles of doc_id so that each
    has about `shard_ids` ids; only packed ids are shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw = materialize(rows.mapInArrow(partial(_tokenize, path=tokenizer_path, end_id=end_id), RAW), "ids")
    found = raw.select("ids").mapInArrow(_count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most one row per id of the vocabulary
    found = found.sort_values(["n", "id"], ascending=[False, True])
    ids = found["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))
    spark = docs.sparkSession
    shards = max(1, -(-int(found["n"].sum()) // shard_ids))
    bounds = np.unique(rows.stat.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.1 / shards)) if shards > 1 else []
    spark.createDataFrame([(int(i), int(rank_of[i])) for i in ids], "id int, rank int").coalesce(1).write.parquet(f"{path}/ranks")
    coded = raw.mapInArrow(partial(_encode, rank_of=rank_of, bounds=np.asarray(bounds, np.float64)), CODED)
    placed = coded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "n", "control", "data")
    placed.mapInArrow(_blocks, BLOCKS).write.parquet(f"{path}/blocks")
    discard(raw)


@lean
def _decode(batches: Iterator[pa.RecordBatch], id_of: np.ndarray, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = id_of[unpack(row["control"], row["data"], np.array(row["lengths"], np.int64))]
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]
            if digest:
                last = pa.array([zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
            else:
                last = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            n = len(ends)
            yield pa.record_batch({"shard": pa.array(np.full(n, row["shard"], np.int32)), "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(row["start"] + starts), "n_tokens": pa.array(np.array(row["lengths"], np.int64)), "last": last})


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of a token file: (doc_id, start, n_tokens, ids array<int>), or ids_crc32 in place of ids; start counts all ids before the document."""
    ranks = spark.read.schema("id int, rank int").parquet(f"{path}/ranks").toPandas()  # at most one row per id of the vocabulary
    id_of = ranks.sort_values("rank")["id"].to_numpy(np.uint32)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sums = blocks.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()  # a row per shard
    base = np.concatenate(([0], np.cumsum([0] * (not sums) + [r.n for r in sums])))
    bases = spark.createDataFrame([(r.shard, int(b)) for r, b in zip(sums, base, strict=False)] or [(0, 0)], "shard int, base long")
    name = "ids_crc32" if digest else "ids"
    rows = blocks.mapInArrow(partial(_decode, id_of=id_of, digest=digest), f"shard int, doc_id long, start long, n_tokens long, last {'long' if digest else 'array<int>'}")
    return rows.join(bases, "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", F.col("last").alias(name))
