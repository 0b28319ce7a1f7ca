"""Counts of pairs of words in sentences, for corpora whose pairs are too many to send one by one.

Words that are in fewer sentences than a pair must be are in no such pair, so they are left out first. The rest are numbered by how frequent they are, and pairs are counted as numbers, in Arrow batches with numpy: each task sorts
some millions of pairs at once and sends what differs, as compressed columns, to the part of the pair's rarer word; a part sorts what it gets. The words, which are far fewer than their pairs, are broadcast."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialize

#: Pairs that are counted at once, and that a part has, about.
PAIRS = 1 << 22
#: Rows of results that are made at once.
ROWS = 1 << 16
#: How many a sentence of n different words has.
PAIRS_OF = "n * (n - 1) div 2"
_ZSTD = pa.Codec("zstd", 1)


class Words:
    """The words that pairs are counted of: the most frequent one has the number 0. They are found by a hash and compared as text."""

    def __init__(self, words: pa.Array, hashes: np.ndarray) -> None:
        self.words, self.order = words, np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]

    def __len__(self) -> int:
        return len(self.words)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each of some distinct words, -1 for one that isn't known."""
        out = np.full(len(words), -1, np.int64)
        if not len(self) or not len(words):
            return out
        h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words.to_pylist()), np.uint64, len(words)).view(np.int64)
        first = np.searchsorted(self.hashes, h)
        for k in (0, 1):  # two words may share a hash
            at = np.minimum(first + k, len(self) - 1)
            mine = np.flatnonzero((self.hashes[at] == h) & (out < 0))
            number = self.order[at[mine]]
            same = pc.equal(self.words.take(pa.array(number)), words.take(pa.array(mine))).to_numpy(zero_copy_only=False)
            out[mine[same]] = number[same]
        return out


def _slots(n: int, parts: int) -> tuple[np.ndarray, int]:
    """Numbers dealt to parts in turn: where each number goes, so that a part has neighbouring slots, and how many slots a part has."""
    width = -(-n // parts)
    number = np.arange(n)
    return number % parts * width + number // parts, width


def _tally(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, sorted, and the sum of the counts of each."""
    if counts is None:
        return np.unique(codes, return_counts=True)
    order = np.argsort(codes)
    codes = codes[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else order
    return codes[first], np.add.reduceat(counts[order], first, dtype=np.int64) if len(codes) else counts


def _packed(*columns: np.ndarray) -> bytes:
    """32-bit columns, compressed by planes of bytes, as most of the upper ones are zero."""
    return _ZSTD.compress(np.ascontiguousarray(np.concatenate(columns).astype("<i4").view(np.uint8).reshape(-1, 4).T), asbytes=True)


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(_ZSTD.decompress(data, 12 * n, asbytes=True), np.uint8).reshape(4, -1)
    return np.split(np.ascontiguousarray(planes.T).view("<i4").ravel(), 3)


def _entries(sentences: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the known words of each sentence, sorted by sentence and number, and which sentence each is of."""
    sizes = sentences.value_lengths().to_numpy(zero_copy_only=False)
    coded = sentences.flatten().dictionary_encode()
    number = words.numbers(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    key = np.repeat(np.arange(len(sizes)), sizes) * max(len(words), 1) + number
    key = np.sort(key[number >= 0])
    return key % max(len(words), 1), key // max(len(words), 1)


def _counted(batches: Iterator[pa.RecordBatch], known, parts: int) -> Iterator[pa.RecordBatch]:
    """Sentences (u) to rows (part, n, data) with the n different pairs of some sentences whose rarer word is dealt to that part."""
    words = known.value
    slot, width = _slots(len(words), parts)

    def rows(number: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends, at = np.cumsum(rank), 0
        while at < len(rank):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            more = rank[at:to]
            p = np.repeat(np.arange(at, to), more)
            q = p - 1 - (np.arange(len(p)) - np.repeat(np.cumsum(more) - more, more))
            at = to
            codes, n = _tally(slot[number[p]] * len(words) + number[q])
            rarer, other = np.divmod(codes, len(words))
            bounds = np.searchsorted(rarer, np.arange(parts + 1) * width)
            full = np.flatnonzero(np.diff(bounds))
            data = [_packed(np.diff(rarer[a:b], prepend=k * width), other[a:b], n[a:b]) for k, a, b in zip(full.tolist(), bounds[full].tolist(), bounds[full + 1].tolist(), strict=True)]
            yield pa.record_batch({"part": pa.array(full.astype(np.int32)), "n": pa.array(np.diff(bounds)[full].astype(np.int32)), "data": pa.array(data, pa.binary())})

    held: list[tuple[np.ndarray, np.ndarray]] = []
    most = 0
    for batch in batches:
        number, sentence = _entries(batch.column("u"), words)
        first = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1])) if len(sentence) else sentence
        rank = np.arange(len(sentence)) - np.repeat(first, np.diff(np.append(first, len(sentence))))  # how many more frequent words the sentence has
        held.append((number, rank))
        most += int(rank.sum())
        if most >= PAIRS:
            yield from rows(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, most = [], 0
    if held:
        yield from rows(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _sums(batches: Iterator[pa.RecordBatch], n_words: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (part, n, data) of whole parts to the numbers of both words of each pair, and its count."""
    slot, width = _slots(n_words, parts)
    codes, counts, open_, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 2 * PAIRS
    for batch in batches:
        for part, n, data in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "data")), strict=True):
            gaps, other, count = _unpacked(data, n)
            codes.append((np.cumsum(gaps, dtype=np.int64) + part * width) * n_words + other)
            counts.append(count.astype(np.int64))
            open_ += n
        if open_ > waiting:  # what is held is summed before it doubles
            codes, counts = ([x] for x in _tally(np.concatenate(codes), np.concatenate(counts)))
            open_, waiting = len(codes[0]), max(2 * len(codes[0]), 2 * PAIRS)
    codes, total = _tally(np.concatenate(codes), np.concatenate(counts))
    rarer, other = np.divmod(codes, max(n_words, 1))
    return rarer % width * parts + rarer // width, other, total


def _named(batches: Iterator[pa.RecordBatch], known, parts: int, least: int) -> Iterator[pa.RecordBatch]:
    """(w1, w2, cnt) of the pairs counted `least` times or more."""
    words = known.value
    a, b, n = _sums(batches, len(words), parts)
    keep = np.flatnonzero(n >= least)
    for k in range(0, len(keep), ROWS):
        rows = keep[k : k + ROWS]
        x, y = (words.words.take(pa.array(c[rows])) for c in (a, b))
        before = pc.less(x, y)
        yield pa.record_batch({"w1": pc.if_else(before, x, y), "w2": pc.if_else(before, y, x), "cnt": pa.array(n[rows])})


def _totals(batches: Iterator[pa.RecordBatch], n_words: int, parts: int, least: int) -> Iterator[pa.RecordBatch]:
    n = _sums(batches, n_words, parts)[2]
    yield pa.record_batch({"different": pa.array([len(n)]), "instances": pa.array([int(n.sum())]), "frequent": pa.array([int((n >= least).sum())])})


def _dealt(sentences: DataFrame, least: int):
    """Of sentences(u, n): the broadcast words that are in `least` of them, the number of parts, and the counted pairs by part."""
    spark = sentences.sparkSession
    words = sentences.select(F.explode("u").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    table = words.select("word", "n", F.xxhash64("word").alias("h")).toArrow()
    order = pc.sort_indices(table, [("n", "descending"), ("word", "ascending")])
    known = Words(table.column("word").take(order).combine_chunks(), table.column("h").take(order).to_numpy())
    n_words, sent = len(known), spark.sparkContext.broadcast(known)
    most = sentences.agg(F.coalesce(F.sum(F.expr(PAIRS_OF)), F.lit(0))).first()[0]
    parts = max(most // PAIRS, min(most >> 16, spark.sparkContext.defaultParallelism)) + 1
    rows = sentences.select("u").mapInArrow(partial(_counted, known=sent, parts=parts), "part int, n int, data binary")
    return sent, n_words, parts, rows.repartitionById(parts, F.col("part"))


def _sentences(corpus: DataFrame) -> DataFrame:
    """corpus(tokens) to the different words of each sentence that has two or more, written once: (u, n)."""
    return materialize(corpus.select(F.array_distinct(F.array_compact("tokens")).alias("u")).select("u", F.size("u").cast("long").alias("n")), "sentences").where("n > 1")


def frequent_pairs(corpus: DataFrame, least: int) -> DataFrame:
    """corpus(tokens) to (w1, w2, cnt), w1 < w2: in how many sentences both occur, of the pairs that do in `least` or more."""
    known, _, parts, rows = _dealt(_sentences(corpus), least)
    return rows.mapInArrow(partial(_named, known=known, parts=parts, least=least), "w1 string, w2 string, cnt long")


def totals(corpus: DataFrame, least: int) -> DataFrame:
    """One row for the pairs of corpus(tokens): different ones (n_unique), instances, and those that occur in `least` sentences or more. A pair with a word of one sentence differs from all others, so such pairs are only counted."""
    sents = _sentences(corpus)
    _, n_words, parts, rows = _dealt(sents, 2)
    found = rows.mapInArrow(partial(_totals, n_words=n_words, parts=parts, least=least), "different long, instances long, frequent long")
    found = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("different", "instances", "frequent")])
    every = sents.agg(F.sum(F.expr(PAIRS_OF)).alias("n_instances"))
    unique = F.col("different") + F.coalesce("n_instances", F.lit(0)) - F.col("instances")
    return every.join(F.broadcast(found)).select(unique.alias("n_unique"), "n_instances", (F.col("frequent") if least > 1 else unique).alias("n_frequent"))  # one row each
