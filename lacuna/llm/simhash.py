"""SimHash near-duplicates by anchor points of a covering code.

A 64-bit fingerprint is placed by 46 of its bits, two words of 23, in the space of a product of two binary Golay codes: every point of a
factor is within 3 bits of one codeword, so a point of the product has one home anchor within the covering radius 6. A fingerprint is
copied to each anchor within 6 + max_bits. If two fingerprints differ in at most max_bits bits, the home of the first lies
within 6 + max_bits of the second, so both meet there; per anchor each home is compared with all that came.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, SLICE_BYTES, blocks, lean, local_components, materialize, runs, slices, text_bytes, word_spans
from .components import connected_components

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the [23, 12] Golay code.
GOLAY = 0b110001110101
RADIUS = 3
#: Shingles hashed at once.
SHINGLES = 1 << 14
#: Pairs compared at once, and from where on a group is resolved without comparing its pairs.
PAIRS = 1 << 18
HOT_PAIRS = 1 << 24


def _lowered_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the words with one space after each, as one buffer; start and end of each word in it; its text."""
    starts, ends, of = word_spans(raw, offsets, NOT_SPACE)
    inside = NOT_SPACE[raw]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # with the first space after a word
    at = np.cumsum(keep, dtype=np.int32)[starts] - 1 if len(starts) else starts
    return np.where(inside, LOWER[raw], np.uint8(0x20))[keep].tobytes(), at, at + (ends - starts).astype(np.int32), of


def _votes(ones: np.ndarray, words: tuple[bytes, np.ndarray, np.ndarray, np.ndarray], width: int, short: bool) -> np.ndarray:
    """Adds to ones[text, bit] the shingles that have the bit, and returns the number of shingles of each text; a text of fewer words than `width` is one shingle if `short`, else none."""
    data, starts, ends, of = words
    n = np.bincount(of, minlength=len(ones))
    count = np.where(n >= width, n - width + 1, (n > 0) & short)
    bounds, first = np.concatenate(([0], np.cumsum(count))), np.cumsum(n) - n
    digest = xxhash.xxh64_intdigest
    for a in range(0, int(bounds[-1]), SHINGLES):
        k = np.arange(a, min(a + SHINGLES, int(bounds[-1])))
        doc = np.searchsorted(bounds, k, "right") - 1
        i = first[doc] + k - bounds[doc]
        j = np.minimum(i + width, first[doc] + n[doc]) - 1
        h = np.fromiter((digest(data[x:y], 42) for x, y in zip(starts[i].tolist(), ends[j].tolist(), strict=True)), np.uint64, len(k))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        ones[doc[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.uint32)
    return count


def majority(part: pa.RecordBatch, width: int) -> np.ndarray:
    """For each text of a result of slices() the word of the bits that over half of its shingles have; no words give 0.

    A shingle is XXH64 (seed 42) of `width` words in a row, repeats included, or of all words where there are fewer. Hashes are made and counted some thousands at a time; a long text is read in blocks."""
    raw, offsets = text_bytes(part.column("text"))
    ones = np.zeros((part.num_rows, 64), np.int64)
    if part.num_rows != 1 or len(raw) <= SLICE_BYTES:
        total = _votes(ones, _lowered_words(raw, offsets), width, True)
    else:
        total, before = np.zeros(1, np.int64), b""
        for a, b in blocks(raw, NOT_SPACE):
            block = np.concatenate((np.frombuffer(before, np.uint8), raw[a:b]))
            words = _lowered_words(block, np.array([0, len(block)]))
            total += _votes(ones, words, width, b == len(raw) and not total[0])
            data, starts, ends, _ = words
            k = min(width - 1, len(starts))
            before = data[starts[-k] : ends[-1]] + b" " if k else b""
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


@lean
def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            yield pa.record_batch({"doc_id": part.column("doc_id"), "fp": pa.array(majority(part, width).view(np.int64))})


def fingerprints(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """docs(doc_id, text) to (doc_id, fp): fp holds the 64 bits as a signed long. Null and empty texts have fp 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_fingerprints, width=shingle_words), "doc_id long, fp long")


def _remainder(x: np.ndarray) -> np.ndarray:
    """Of each 23-bit word, the remainder by the generator: its syndrome."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x = np.where((x >> bit) & 1, x ^ (GOLAY << (bit - 11)), x)
    return x


@cache
def _patterns(max_bits: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """class_of[syndrome], and by class a table [syndrome, k] of the error patterns of up to RADIUS + max_bits bits with that syndrome, and their weights.

    A class holds the syndromes of one leader weight 0 to 3. The code is completely regular, so in a class all syndromes have as many patterns of each weight."""
    words = [0]
    for k in range(1, RADIUS + max_bits + 1):
        words += [sum(1 << i for i in c) for c in combinations(range(23), k)]
    e = np.array(words, np.int64)
    weight, syndrome = np.bitwise_count(e).astype(np.int64), _remainder(e)
    order = np.lexsort((e, weight, syndrome))
    e, weight, syndrome = e[order], weight[order], syndrome[order]
    bounds = runs(syndrome)
    leader = weight[bounds[:-1]]
    tables = []
    for c in range(RADIUS + 1):
        mine = np.flatnonzero(leader == c)
        size = int(bounds[mine[0] + 1] - bounds[mine[0]])
        table = np.zeros((2048, size), np.int64)
        table[mine] = e[bounds[mine][:, None] + np.arange(size)]
        tables.append((table, weight[bounds[mine[0]] : bounds[mine[0]] + size]))
    return leader.astype(np.int64), tables


def anchors(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor, is its home) for each anchor within the covering radius plus max_bits."""
    left, right = ((fp >> np.uint64(s)) & np.uint64(0x7FFFFF) for s in (0, 23))
    left, right = left.astype(np.int64), right.astype(np.int64)
    class_of, tables = _patterns(max_bits)
    s1, s2 = _remainder(left), _remainder(right)
    out: list[tuple[np.ndarray, ...]] = []
    for a, (t1, w1) in enumerate(tables):
        for b, (t2, w2) in enumerate(tables):
            mine = np.flatnonzero((class_of[s1] == a) & (class_of[s2] == b))
            if not len(mine):
                continue
            i, j = np.nonzero(w1[:, None] + w2[None, :] <= 2 * RADIUS + max_bits)
            c1 = (left[mine, None] ^ t1[s1[mine]][:, i]) >> 11
            c2 = (right[mine, None] ^ t2[s2[mine]][:, j]) >> 11
            home = np.broadcast_to((i == 0) & (j == 0), c1.shape)
            out.append((np.repeat(mine, len(i)), ((c1 << 12) | c2).ravel(), home.ravel()))
    if not out:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _replicate(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(fp), 1024):
            part = fp[at : at + 1024]
            i, anchor, home = anchors(part, max_bits)
            yield pa.record_batch({"place": pa.array(2 * anchor + ~home), "fp": pa.array(part[i].view(np.int64))})


def _linked(place: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index, index) of linked rows of whole groups, sorted by place."""
    anchor = place >> 1
    bounds = runs(anchor)
    size = np.diff(bounds)
    homes = np.add.reduceat((place & 1) == 0, bounds[:-1], dtype=np.int64) if len(size) else size
    reps = np.repeat(homes, size)
    first = np.repeat(bounds[:-1], size)
    us, vs = [], []
    ends = np.cumsum(reps)
    at = 0
    while at < len(place):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        r = reps[at:to]
        y = np.repeat(np.arange(at, to), r)
        h = first[y] + np.arange(len(y)) - np.repeat(np.cumsum(r) - r, r)
        near = (np.bitwise_count(fp[y] ^ fp[h]) <= max_bits) & (y != h)
        us.append(y[near])
        vs.append(h[near])
        at = to
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2


@lean
def _compare(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by place to star edges (u, v), one star for each set of linked fingerprints of an anchor. A group with too many
    pairs goes through as rows (fp, null), without being held, and is resolved by hot_edges."""

    def stars(place: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        u, v = _linked(place, fp, max_bits)
        root = local_components(len(fp), u, v)
        mine = np.flatnonzero(root != np.arange(len(fp)))
        return edge_batch(fp[mine], fp[root[mine]])

    def edge_batch(u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
        u = u.view(np.int64)
        return pa.record_batch({"u": pa.array(u), "v": pa.array(v.view(np.int64)) if v is not None else pa.nulls(len(u), pa.int64())})

    place, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hot = -1
    for batch in batches:
        p, f = batch.column("place").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if hot >= 0:
            k = int(np.searchsorted(p >> 1, hot, "right"))
            if k:
                yield edge_batch(f[:k], None)
                p, f = p[k:], f[k:]
            if not len(p):
                continue
            hot = -1
        place, fp = np.concatenate((place, p)), np.concatenate((fp, f))
        if not len(place):
            continue
        bounds = runs(place >> 1)
        homes = np.add.reduceat((place & 1) == 0, bounds[:-1], dtype=np.int64)
        for g in np.flatnonzero(homes * np.diff(bounds) > HOT_PAIRS):
            yield edge_batch(fp[bounds[g] : bounds[g + 1]], None)
            if g == len(homes) - 1:
                hot = int(place[bounds[g]] >> 1)
        keep = np.repeat(homes * np.diff(bounds) <= HOT_PAIRS, np.diff(bounds))
        done = keep & (np.arange(len(place)) < bounds[-2])
        if done.any():
            yield stars(place[done], fp[done])
        rest = keep & ~done
        place, fp = place[rest], fp[rest]
    if len(place):
        yield stars(place, fp)


def _meeting_points(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Each fingerprint at all words within half of max_bits, rounded up; `near` where half rounded down reaches. Of two within max_bits, one is near a word that the other reaches too."""
    flips = [0] + [sum(1 << i for i in c) for k in range(1, (max_bits + 1) // 2 + 1) for c in combinations(range(64), k)]
    near = np.bitwise_count(np.array(flips, np.uint64)) <= max_bits // 2
    flips = np.array(flips, np.uint64)
    for batch in batches:
        fp = batch.column("u").to_numpy().view(np.uint64)
        rows = max((1 << 18) // len(flips), 1)
        for at in range(0, len(fp), rows):
            part = fp[at : at + rows]
            u = np.repeat(part, len(flips))
            yield pa.record_batch({"point": pa.array((part[:, None] ^ flips).ravel().view(np.int64)), "u": pa.array(u.view(np.int64)), "near": pa.array(np.tile(near, len(part)))})


def hot_edges(hot: DataFrame, max_bits: int) -> DataFrame:
    """Links within crowded anchors without comparing pairs: all that meet at one word are linked to the smallest that is near it. The minimum is combined before the shuffle."""
    met = hot.select("u").distinct().mapInArrow(partial(_meeting_points, max_bits=max_bits), "point long, u long, near boolean")
    least = met.groupBy("point").agg(F.min(F.when(F.col("near"), F.col("u"))).alias("v"), F.min("u").alias("low"), F.max("u").alias("high")).where("v IS NOT NULL AND low < high").select("point", "v")
    return met.join(least, "point").where("u <> v").select("u", "v").distinct()


def link_edges(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """fps(fp), distinct, to edges (u, v) whose connected components are those of all pairs within max_bits bits."""
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = fps.repartition(n).mapInArrow(partial(_replicate, max_bits=max_bits), "place long, fp long")  # dealt by count: the rows are few, their copies many
    ordered = spread.repartition(n, F.shiftright("place", 1)).sortWithinPartitions("place")
    found = materialize(ordered.mapInArrow(partial(_compare, max_bits=max_bits), "u long, v long"), "links", free=True)
    edges = found.where("v is not null")
    hot = found.where("v is null")
    if hot.isEmpty():
        return edges
    return edges.unionByName(hot_edges(hot, max_bits))


def near_duplicate_groups(docs: DataFrame, shingle_words: int = 5, max_bits: int = 2) -> DataFrame:
    """docs(doc_id, text) to (doc_id, fp, component_id).

    Fingerprints link at max_bits or fewer differing bits; component_id is the smallest doc_id reachable over links, the document itself included.
    Equal fingerprints are one node, so copies are never paired. A null or empty text has fingerprint 0 and is linked like any other. Rows with the same doc_id
    keep a row each; a null doc_id keeps its row and never is the smallest. An empty table gives no rows. Other columns are ignored.
    """
    marked = materialize(fingerprints(docs, shingle_words), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(link_edges(nodes.select("fp"), max_bits))
    placed = nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "placed")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(placed.join(smallest, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
