"""Benchmark decontamination with a distributed positional inverted index.

The training texts become index rows, each for the documents of one slice of input: its terms (64 bits of BLAKE2b, sorted) and for each term the list of its positions. The
rows are stored once in the shared folder. Test windows are found by intersecting lists adjusted by the term's offset in the window, beginning with
the term that is rarest over the whole index. Test items are taken in blocks of bounded size, so nothing that is sent to the executors grows with either table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, coded_words, lean, materialize, parts_of, runs, slices, text_bytes, word_hashes

#: Bytes of words before lower-casing.
ALNUM_ANY_CASE = ALNUM[LOWER]
#: Words of test items searched for at once.
BLOCK_WORDS = 1 << 20
INDEX = "chunk long, base long, lengths array<long>, doc_ids array<long>, n_words array<long>, terms binary, counts binary, positions binary"


def terms(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of lower-cased texts, and the number of words of each text."""
    words, number, of = coded_words(low, offsets, ALNUM)
    return word_hashes(words)[number], np.bincount(of, minlength=len(offsets) - 1).astype(np.int64)


@lean
def _index(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[pa.RecordBatch]:
    """A row per slice of texts, several of one chunk for a long text: `base` counts the words before the row's first, and each row repeats the last `overlap` words of the one before; doc_ids and n_words are in the last."""
    squeeze = zstandard.ZstdCompressor(level=1)
    chunk, base, carried = 0, 0, np.zeros(0, np.uint64)
    longs = pa.list_(pa.int64())
    for batch in batches:
        for part, raw, offsets, first, last in parts_of(batch, ALNUM_ANY_CASE):
            words, lengths = terms(LOWER[raw], offsets)
            if first:
                chunk, base, carried = uuid.uuid4().int >> 65, 0, words[:0]
            n_words = lengths
            if not (first and last):
                words = np.concatenate((carried, words))
                lengths = np.array([len(words)])
                n_words = lengths + base
            order = np.argsort(words, kind="stable")
            bounds = runs(words[order])
            gaps = np.diff(order, prepend=0).astype(np.int32)
            gaps[bounds[:-1]] = order[bounds[:-1]]
            distinct = words[order][bounds[:-1]]
            yield pa.record_batch({
                "chunk": pa.array([chunk]), "base": pa.array([base]), "lengths": pa.array([lengths], longs), "doc_ids": pa.array([part.column("doc_id").to_pylist() if last else []], longs),
                "n_words": pa.array([n_words if last else []], longs), "terms": pa.array([distinct.tobytes()], pa.binary()),
                "counts": pa.array([squeeze.compress(np.diff(bounds).astype(np.int32).tobytes())], pa.binary()),
                "positions": pa.array([squeeze.compress(gaps.tobytes())], pa.binary()),
            })
            if not last:
                carried = words[len(words) - min(overlap, len(words)) :]
                base += len(words) - len(carried)


def build_index(docs: DataFrame, overlap: int = 9) -> DataFrame:
    """The positional index of docs(doc_id, text), written to the shared folder. Windows of up to overlap + 1 words are found across the parts of long texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(partial(_index, overlap=overlap), INDEX), "postings")


def _postings(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """terms, bounds of their lists, and positions: the number of the word among all words of the row."""
    undo = zstandard.ZstdDecompressor()
    distinct = np.frombuffer(row["terms"], np.uint64)
    counts = np.frombuffer(undo.decompress(row["counts"]), np.int32).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    gaps = np.frombuffer(undo.decompress(row["positions"]), np.int32).astype(np.int64)
    run = np.cumsum(gaps)
    if len(counts):
        run -= np.repeat(run[bounds[:-1]] - gaps[bounds[:-1]], counts)
    return distinct, bounds, run


def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(vocabulary), np.int64)
    undo = zstandard.ZstdDecompressor()
    for batch in batches:
        for t, c in zip(batch.column("terms"), batch.column("counts"), strict=True):
            distinct = np.frombuffer(t.as_py(), np.uint64)
            counts = np.frombuffer(undo.decompress(c.as_py()), np.int32)
            at = np.minimum(np.searchsorted(distinct, vocabulary), max(len(distinct) - 1, 0))
            if len(distinct):
                total += np.where(distinct[at] == vocabulary, counts[at], 0)
    k = np.flatnonzero(total)
    yield pa.record_batch({"k": pa.array(k.astype(np.int32)), "n": pa.array(total[k])})


class Windows:
    """The windows of one block of items, one after another: their terms as numbers into a vocabulary, with offsets ordered from the rarest term on."""

    def __init__(self, item_ids: list, words: list[np.ndarray], width: int) -> None:
        self.vocabulary = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
        sizes = np.array([len(w) for w in words], np.int64)
        count = np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0)
        of = np.repeat(np.arange(len(words)), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + (np.cumsum(sizes) - sizes)[of]
        self.ids, self.item = pa.array(item_ids, pa.int64()), of
        self.size = np.minimum(sizes, width)[of]
        number = np.searchsorted(self.vocabulary, np.concatenate([*words, np.zeros(0, np.uint64)]))
        self._fill(number[np.repeat(at - (np.cumsum(self.size) - self.size), self.size) + np.arange(int(self.size.sum()))])

    def _fill(self, terms: np.ndarray) -> None:
        self.terms = terms.astype(np.int32)
        self.bounds = np.concatenate(([0], np.cumsum(self.size)))

    def rank(self, frequency: np.ndarray) -> None:
        """Drops windows with a term that the index lacks and orders the terms of the rest."""
        keep = self.with_all(frequency > 0)
        inside = np.zeros(len(self.size), bool)
        inside[keep] = True
        terms = self.terms[np.repeat(inside, self.size)]
        self.item, self.size = self.item[keep], self.size[keep]
        self._fill(terms)
        window = np.repeat(np.arange(len(self.size)), self.size)
        self.order = (np.lexsort((frequency[self.terms], window)) - self.bounds[:-1][window]).astype(np.int16)

    def with_all(self, present: np.ndarray) -> np.ndarray:
        """The windows all of whose terms are present."""
        return np.flatnonzero(np.logical_and.reduceat(present[self.terms], self.bounds[:-1])) if len(self.size) else np.zeros(0, np.int64)


def _near(sorted_list: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which of the wanted positions have an entry at most slop away."""
    at = np.searchsorted(sorted_list, wanted - slop)
    return (at < len(sorted_list)) & (sorted_list[np.minimum(at, len(sorted_list) - 1)] <= wanted + slop)


@lean
def _search(batches: Iterator[pa.RecordBatch], windows: Windows, slop: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            distinct, bounds, positions = _postings(row)
            if not len(distinct):
                continue
            at = np.minimum(np.searchsorted(distinct, windows.vocabulary), len(distinct) - 1)
            doc_ends = np.cumsum(row["lengths"])
            found = []
            for k in windows.with_all(distinct[at] == windows.vocabulary).tolist():
                numbers, order = (x[windows.bounds[k] : windows.bounds[k + 1]] for x in (windows.terms, windows.order))
                base = at[numbers[order[0]]]
                start = positions[bounds[base] : bounds[base + 1]] - int(order[0])
                start = start[start >= 0]
                for o in order[1:].tolist():
                    if not len(start):
                        break
                    a = at[numbers[o]]
                    start = start[_near(positions[bounds[a] : bounds[a + 1]], start + o, slop)]
                doc = np.searchsorted(doc_ends, start, "right")
                same = np.searchsorted(doc_ends, start + len(numbers) - 1, "right") == doc
                if same.any():
                    found.append((np.full(int(same.sum()), k), doc[same], start[same]))
            if found:
                k, doc, start = (np.concatenate(x) for x in zip(*found, strict=True))
                begins = doc_ends - row["lengths"]
                yield pa.record_batch({
                    "chunk": pa.array(np.full(len(k), row["chunk"])), "at": pa.array(doc.astype(np.int32)), "item_id": windows.ids.take(pa.array(windows.item[k])), "start": pa.array(start - begins[doc] + row["base"]), "n": pa.array(windows.size[k]),
                })


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            raw, offsets = text_bytes(part.column("text"))
            words, count = terms(LOWER[raw], offsets)
            offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            yield pa.record_batch({"item_id": part.column("item_id"), "words": pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.view(np.int64)))})


def find_windows(index: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """Occurrences (chunk, at, item_id, start, n) of the windows of benchmark(item_id, text) in the index: item_id's window of n words begins at word
    `start` of document number `at` of index row `chunk`. With slop > 0 also proximity matches: each term at most slop words from its place relative to the rarest."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_words, "item_id long, words array<long>")
    items = materialize(items.where(F.size("words") > 0), "items")
    blocks = int(items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]) // BLOCK_WORDS + 1
    out = None
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b).collect()  # about BLOCK_WORDS words
        windows = Windows([r.item_id for r in mine], [np.array(r.words, np.int64).view(np.uint64) for r in mine], width)
        counted = index.select("terms", "counts").mapInArrow(partial(_frequencies, vocabulary=windows.vocabulary), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
        frequency = np.zeros(len(windows.vocabulary), np.int64)
        for r in counted:
            frequency[r.k] = r.n
        windows.rank(frequency)
        found = index.mapInArrow(partial(_search, windows=windows, slop=slop), "chunk long, at int, item_id long, start long, n long")
        out = found if out is None else out.unionByName(found)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """docs(doc_id, text) and benchmark(item_id, text) to a row per document: (doc_id, n_words, n_hit, item_ids array<string>, spans).

    A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window. n_hit counts words of the document inside any
    occurrence of any window; item_ids are the items with occurring windows, sorted as strings; spans are the hit stretches (from, to) in words, one for each item and stretch.
    Null and empty texts have no words: such documents have no hit and such items no window. An item without item_id hits like others and is in no list. Rows that repeat a doc_id keep a row each. An
    empty benchmark hits nothing; an empty docs gives no rows. Other columns are ignored.
    """
    index = build_index(docs, width - 1 + 2 * slop)
    found = find_windows(index, benchmark, width, slop)
    ahead = Window.partitionBy("chunk", "at").orderBy("start", "to").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("chunk", "at", "item_id", "start", (F.col("start") + F.col("n")).alias("to")).withColumn("reached", F.max("to").over(ahead))
    fresh = F.greatest(F.lit(0), F.col("to") - F.greatest("start", F.coalesce("reached", "start")))
    hits = spans.groupBy("chunk", "at").agg(
        F.sum(fresh).alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
        F.sort_array(F.collect_set(F.struct("item_id", F.col("start").alias("from"), "to"))).alias("spans"),
    )
    each = index.select("chunk", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("at", "d")).select("chunk", "at", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    joined = each.join(hits, ["chunk", "at"], "left")
    none = F.array().cast("array<string>")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), "spans")


#: The same windows in DuckDB SQL; A-Z only are lowered.
CONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, i, k FROM dw JOIN win USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
