"""Quality classifier by importance resampling: documents are weighted by target(text) / raw(text), two generative models of hashed n-grams, and the best
are sampled by Gumbel top-k.

The weight is taken to the power 1 / number of n-grams, else length would outdo content: log_weight is the mean log ratio of the n-grams. The
n-grams of a text are its byte 4-grams and, so that texts which repeat themselves stand out, triples of recency classes of neighbouring words (how long ago the
word was last used in the text). The raw model is counted over all documents, the target model over documents labelled good.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, coded_words, lean, materialize, parts_of, word_hashes

BUCKETS = 1 << 16
#: Labelled rows that the target model and the cut are fitted on, at most; which, a hash of doc_id decides.
LABELLED = 20_000
#: A word's class: 0 new; 1 the word before; 2, 3, 4 up to 4, 16, 64 words ago; 5 longer ago.
_LIMITS = np.array([1, 4, 16, 64])
PRIOR = 4.0
#: Neutral n-grams added to each text, which keep the weights of a few n-grams near 0.
SHORT = 32
#: Scale of the noise of the sample. At 0 it is a plain cut; the larger, the more documents near the cut change places from seed to seed.
TEMPERATURE = 0.15
#: Bins of a round of the search for the k-th key.
BINS = 4096


class _Memory:
    """What a long text's next block needs of those before: the last bytes, the words so far (hashes, sorted) with their last places, the number of words, and the last classes."""

    def __init__(self) -> None:
        self.bytes, self.words, self.last, self.n, self.kinds = np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, np.zeros(0, np.int64)


def _recency(raw: np.ndarray, offsets: np.ndarray, memory: _Memory | None) -> tuple[np.ndarray, np.ndarray]:
    """Triples of classes as numbers below 216, and their texts."""
    words, number, of = coded_words(raw, offsets, NOT_SPACE)
    key = of * max(len(words), 1) + number
    order = np.argsort(key, kind="stable")
    ago = np.zeros(len(key), np.int64)
    same = key[order][1:] == key[order][:-1]
    ago[order[1:][same]] = np.diff(order)[same]
    if memory is not None:
        h = word_hashes(words)
        first, last = np.full(len(h), -1), np.zeros(len(h), np.int64)
        last[number] = np.arange(len(number)) + memory.n
        first[number[::-1]] = np.arange(len(number))[::-1]
        if len(memory.words):
            at = np.minimum(np.searchsorted(memory.words, h), len(memory.words) - 1)
            old = memory.words[at] == h
            ago[first[old]] = first[old] + memory.n - memory.last[at[old]]
        every, place = np.concatenate((h, memory.words)), np.concatenate((last, memory.last))
        memory.words, keep = np.unique(every, return_index=True)  # the first of two is the later place
        memory.last, memory.n = place[keep], memory.n + len(number)
    kind = np.where(ago == 0, 0, 1 + np.searchsorted(_LIMITS, ago))
    if memory is not None:
        kind, of = np.concatenate((memory.kinds, kind)), np.zeros(len(memory.kinds) + len(kind), np.int64)
        memory.kinds = kind[-2:]
    triple = kind[:-2] * 36 + kind[1:-1] * 6 + kind[2:]
    inside = of[:-2] == of[2:]
    return triple[inside].astype(np.int32), of[:-2][inside].astype(np.int32)


def ngrams(raw: np.ndarray, offsets: np.ndarray, memory: _Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of the texts (raw, offsets: see text_bytes), and its text. With a memory: of the next block of one long text."""
    triples, of2 = _recency(raw, offsets, memory)
    if memory is not None:
        raw = np.concatenate((memory.bytes, raw))
        offsets, memory.bytes = np.array([0, len(raw)]), raw[-3:]
    if len(raw) < 4:
        return BUCKETS + triples, of2
    word = raw.astype(np.uint32)
    word = word[:-3] | word[1:-2] << 8 | word[2:-1] << 16 | word[3:] << 24
    whole = np.ones(len(word), bool)
    for back in (1, 2, 3):
        stop = offsets[1:-1] - back
        whole[stop[(stop >= 0) & (stop < len(word))]] = False
    size = np.maximum(np.diff(offsets) - 3, 0)
    grams = ((word[whole] * np.uint32(2654435769)) >> np.uint32(16)).astype(np.int32)
    return np.concatenate((grams, BUCKETS + triples)), np.concatenate((np.repeat(np.arange(len(size), dtype=np.int32), size), of2))


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, bool, bool]]:
    """(rows, n-grams, their texts, first, last) of slices or of blocks of long texts."""
    memory = None
    for batch in batches:
        for part, raw, offsets, first, last in parts_of(batch, NOT_SPACE):
            memory = None if first and last else _Memory() if first else memory
            yield part, *ngrams(raw, offsets, memory), first, last


WIDTH = BUCKETS + 216


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, WIDTH), np.int64)
    for part, grams, of, _, _ in _grams_of(batches):
        good = part.column("good").fill_null(False).to_numpy(zero_copy_only=False)
        total[0] += np.bincount(grams, minlength=WIDTH)
        if good.any():
            total[1] += np.bincount(grams[good[of]], minlength=WIDTH)
    k = np.flatnonzero(total[0])
    yield pa.record_batch({"bucket": pa.array(k.astype(np.int32)), "raw": pa.array(total[0, k]), "target": pa.array(total[1, k])})


@lean
def _weigh(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    sums = counts = np.zeros(1)
    for part, grams, of, first, last in _grams_of(batches):
        more = np.bincount(of, weights=ratio[grams], minlength=part.num_rows), np.bincount(of, minlength=part.num_rows)
        sums, counts = more if first else (sums + more[0], counts + more[1])
        if last:
            yield pa.record_batch({"row": part.column("row"), "doc_id": part.column("doc_id"), "log_weight": pa.array(sums / (SHORT + counts))})


@lean
def _weigh_held_out(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(log_weight, good) of labelled documents, each by the model that has been counted without it. counts: rows raw and target by bucket."""
    held = [np.zeros(0, np.int32)]
    for part, grams, of, first, last in _grams_of(batches):
        if not (first and last):
            held = [grams] if first else [*held, grams]
            if not last:
                continue
            grams = np.concatenate(held)
            of = np.zeros(len(grams), np.int32)
        good = part.column("good").to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(part.num_rows + 1))
        weights = []
        for k in range(part.num_rows):
            bucket, n = np.unique(grams[order[ends[k] : ends[k + 1]]], return_counts=True)
            weights.append(float(n @ ratios(*counts, bucket, n * good[k])) / (SHORT + int(n.sum())))
        yield pa.record_batch({"log_weight": pa.array(weights, pa.float64()), "good": part.column("good")})


def ratios(raw: np.ndarray, target: np.ndarray, bucket: np.ndarray | None = None, without: np.ndarray | int = 0) -> np.ndarray:
    """log(target / raw) of all buckets, or of some, after `without` has been taken off the target there; PRIOR pseudo-counts drawn from the raw model keep rare n-grams near 0. The two families of n-grams are models of
    their own. No target: 0."""
    bucket = np.arange(WIDTH) if bucket is None else bucket
    own = np.broadcast_to(without, bucket.shape)
    out = np.zeros(len(bucket))
    for part, here in ((slice(0, BUCKETS), bucket < BUCKETS), (slice(BUCKETS, WIDTH), bucket >= BUCKETS)):
        k = bucket[here]
        expected = raw[k] * ((target[part].sum() - own[here].sum()) / max(raw[part].sum(), 1))
        out[here] = np.log((target[k] - own[here] + PRIOR) / (expected + PRIOR))
    return out


def counts(docs: DataFrame, labelled: DataFrame) -> np.ndarray:
    """How often each bucket is found in all documents, and in those labelled good. labelled(doc_id, good) must be small."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(labelled.where("good")), "doc_id", "left").select("text", "good")
    counted = rows.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # at most WIDTH rows
    table = np.zeros((2, WIDTH))
    table[0, counted["bucket"]] = counted["raw"]
    table[1, counted["bucket"]] = counted["target"]
    return table


def best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """A cut between the labels: most good at or above it and bad below it, both as shares; of equally good cuts the middle of the widest gap."""
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    if g.all() or not g.any():
        return -np.inf
    gain = np.concatenate(([0], np.cumsum(np.where(g, -1 / g.sum(), 1 / (~g).sum()))))
    edges = np.concatenate(([w[0]], (w[1:] + w[:-1]) / 2, [w[-1]]))
    gap = np.concatenate(([0], np.diff(w), [0]))
    return float(edges[np.lexsort((-gap, -np.round(gain, 9)))[0]])


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value, by histograms of ever smaller ranges; only bins are collected, and at last the few values of one bin."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return -np.inf
    if k <= 0:
        return np.inf
    above = 0
    while True:
        inside = F.col(column).between(low, high)
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            return low
        bins = keys.where(inside).groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)).alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("b")).collect()
        for r in bins:
            if above + r.n >= k:
                break
            above += r.n
        low, high = r.low, r.high
        if r.n <= BINS:
            values = sorted((x[0] for x in keys.where(F.col(column).between(low, high)).select(column).collect()), reverse=True)
            return values[k - above - 1]


def gumbel_keys(weighed: DataFrame, temperature: float, seed: int) -> DataFrame:
    """weighed(doc_id, log_weight) with gumbel_key: log_weight + temperature * Gumbel noise from a hash of seed and doc_id. The k largest are a sample without replacement by weights exp(log_weight / temperature)."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return weighed.withColumn("gumbel_key", F.col("log_weight") - temperature * F.log(-F.log(uniform)))


def resample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, temperature: float = TEMPERATURE, seed: int = 17) -> DataFrame:
    """docs(doc_id, text) and labels(doc_id, quality) to (row, doc_id, log_weight, gumbel_key, kept), a row per document; row numbers the rows of docs only within this result.

    kept marks the k largest keys of gumbel_keys(), a sample of k documents without replacement, each drawn in proportion to its weight to the power 1 / temperature; another seed draws another sample. k is the number of documents whose weight is at or above a cut that parts the
    labelled good from the labelled bad best. Labelled documents are weighed for the cut by a model counted without them. At most `labelled` rows of labels are used. Without labels of both kinds all are kept; without good ones all weights are 1. A null or
    empty text has no n-grams and log weight 0. Rows that repeat doc_id and text get the same key and stay or go together, so ties at the cut may keep more than k. A null doc_id has noise of its own. No rows give no rows.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good")).where("doc_id IS NOT NULL AND good IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    known = materialize(known, "labelled")
    counted = counts(docs, known)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "good")
    sample = texts.mapInArrow(partial(_weigh_held_out, counts=counted), "log_weight double, good boolean").toPandas()  # a row per labelled document
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    weighed = materialize(rows.mapInArrow(partial(_weigh, ratio=ratios(*counted)), "row long, doc_id long, log_weight double"), "weights")
    cut = best_cut(sample["log_weight"].to_numpy(), sample["good"].to_numpy(bool)) if len(sample) else -np.inf
    keyed = gumbel_keys(weighed, temperature, seed)
    k = weighed.where(F.col("log_weight") >= F.lit(cut)).count()
    return keyed.withColumn("kept", F.col("gumbel_key") >= F.lit(kth_largest(keyed, "gumbel_key", k)))


def rejected(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """(doc_id) of the documents that resample() rejects. doc_id must tell documents apart; one without doc_id is never among them."""
    return resample(docs, labels, **settings).where("NOT kept AND doc_id IS NOT NULL").select("doc_id")
