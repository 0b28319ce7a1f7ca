"""Removal of long byte strings that occur earlier in the corpus, with a run-length compressed index.

1. Every window of `length` bytes belongs to its minimizer, the leftmost smallest hash of the 32-byte strings in it. Neighbouring windows with one minimizer make a piece. Equal windows have equal minimizers, so
   equal windows meet if pieces are dealt by minimizer. Equal pieces are a class: its earliest member represents it, the others are removed whole. Classes are first formed by the texts that a task reads, so that few copies
   travel. Members agree with their representative in a 64-bit hash of the minimizer and one of the piece; those that meet in one slice of input are compared byte by byte besides.
2. Where a minimizer is left with representatives of different content, these are fetched and indexed: a Burrows-Wheeler transform compressed to its runs, with text positions
   sampled at the ends of runs. Later pieces are streamed backwards over an index of earlier ones, which gives matching statistics (for each place the longest match, and where), and windows that start a match of
   `length` or more are removed.
3. A minimizer with very many different pieces (next to a passage that a large share of all documents has) would have to be streamed over an index of them all in one task, or over each of many. Its windows become
   pieces of their own instead, dealt by 128 bits of their content.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, lean, materialize, mix, runs, slices, text_bytes

GRAM = 32
#: Different pieces of one minimizer, from where on its windows are pieces of their own.
CROWD = 32
#: Bytes of pieces indexed together, and pieces cut out or hashed at once.
INDEX_BYTES = 2 << 20
AT_ONCE = 2048
#: Classes that a task remembers from the slices it has read, at most; others form again at the shuffle.
REMEMBERED = 1 << 16
_COUNT_BITS = 8


class Grams:
    """Hashes of all 32-byte strings of some bytes, and of longer stretches by those in them. The end is padded."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        padded = np.zeros(n + GRAM + 8, np.uint8)
        padded[:n] = raw
        self.words = np.ndarray((n + GRAM,), "<u8", padded.data, 0, (1,))
        h = np.zeros(n, np.uint64)
        for k in range(0, GRAM, 8):
            h ^= self.words[k : k + n]
            h *= np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            h ^= h >> np.uint64(31)
        self.h = h

    def minimizers(self, width: int) -> np.ndarray:
        """For each start of `width` strings in a row the position of the leftmost one with the smallest hash."""
        n = len(self.h)
        best, place, have = self.h, np.arange(n, dtype=np.int32), 1
        while have < width:
            step = min(have, width - have)
            right, at = np.append(best[step:], np.full(step, np.iinfo(np.uint64).max, np.uint64)), np.append(place[step:], np.full(step, n, np.int32))
            take = right < best
            best, place = np.where(take, right, best), np.where(take, at, place)
            have += step
        return place

    def spans(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        """A hash of each stretch of 32 bytes or more."""
        out = mix((end - start).astype(np.uint64) + np.uint64(0xA0761D6478BD642F * (seed + 1) % (1 << 64)))
        left = np.arange(len(start))
        at = start.copy()
        while len(left):
            out[left] = mix(out[left] ^ self.h[at[left]])
            at[left] += GRAM
            left = left[at[left] < end[left]]
            at[left] = np.minimum(at[left], end[left] - GRAM)
        return out

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of `size` bytes, 8 or more, from a and from b on are the same bytes."""
        out = np.ones(len(a), bool)
        for k in range(0, int(size.max()) if len(size) else 0, 8):
            more = np.flatnonzero(k < size)
            step = np.minimum(k, size[more] - 8)
            out[more] &= self.words[a[more] + step] == self.words[b[more] + step]
        return out


def _before(d1: np.ndarray, at: np.ndarray, d1_other: np.ndarray, at_other: np.ndarray) -> np.ndarray:
    return (d1 < d1_other) | ((d1 == d1_other) & (at < at_other))


class _Classes:
    """The earliest pieces so far of classes that had several members in one slice of a task."""

    def __init__(self) -> None:
        self.deal, self.content, self.d1, self.at = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def earlier(self, deal: np.ndarray, content: np.ndarray, d1: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which pieces have an earlier one of their class here."""
        if not len(self.deal) or not len(deal):
            return np.zeros(len(deal), bool)
        k = np.minimum(np.searchsorted(self.deal, deal), len(self.deal) - 1)
        return (self.deal[k] == deal) & (self.content[k] == content) & _before(self.d1[k], self.at[k], d1, at)

    def add(self, deal: np.ndarray, content: np.ndarray, d1: np.ndarray, at: np.ndarray) -> None:
        columns = [np.concatenate(x)[-REMEMBERED:] for x in ((self.deal, deal), (self.content, content), (self.d1, d1), (self.at, at))]
        order = np.lexsort((columns[3], columns[2], columns[0]))
        first = order[runs(columns[0][order])[:-1]] if len(order) else order  # one class of each minimizer
        self.deal, self.content, self.d1, self.at = (x[first] for x in columns)


def _stretches(batch: pa.RecordBatch, length: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(raw, offsets, d1, base): slices of the batch, or parts of one long text, from byte `base` on. Parts overlap by length - 1, so that each window is in one."""
    for part in slices(batch, most=most):
        raw, offsets = text_bytes(part.column("text"))
        d1 = part.column("d1").to_numpy()
        if part.num_rows > 1 or len(raw) <= most:
            yield raw, offsets, d1, 0
            continue
        for a in range(0, len(raw) - length + 1, most):
            yield raw[a : a + most + length - 1], np.array([0, min(most + length - 1, len(raw) - a)]), d1, a


@lean
def _pieces(batches: Iterator[pa.RecordBatch], length: int, most: int) -> Iterator[pa.RecordBatch]:
    """(deal, content, d1, at) of the earliest of equal pieces of the slice; its others are removed: rows with 0 windows in `at`, whose content is the number of bytes."""
    classes = _Classes()
    for batch in batches:
        for raw, offsets, ids, base in _stretches(batch, length, most):
            size = np.diff(offsets)
            windows = np.where(size >= length, size - length + 1, 0)
            if not windows.any():
                continue
            grams = Grams(raw)
            place = grams.minimizers(length - GRAM + 1)
            start = np.flatnonzero(np.repeat(np.tile([True, False], len(size)), np.stack((windows, size - windows), 1).ravel()))
            key = place[start]
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)))
            first, count = start[cut], np.diff(np.append(cut, len(start)))
            of = np.searchsorted(offsets, first, "right") - 1
            deal, content = grams.h[key[cut]], grams.spans(first, first + count + length - 1)
            d1, at = ids[of], (first - offsets[of] + base) << _COUNT_BITS | count
            order = np.lexsort((at, d1, content, deal))
            same = np.zeros(len(order), bool)
            same[1:] = (deal[order][1:] == deal[order][:-1]) & (content[order][1:] == content[order][:-1])
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            i, j = order[same], order[lead[same]]
            differs = ~grams.same(first[i], first[j], count[i] + length - 1)
            content[i[differs]] ^= i[differs].astype(np.uint64) + np.uint64(1)  # a class of its own
            twin = (d1[i] == d1[j]) & (at[i] == at[j])  # the same document again
            stay = order[~same]
            known = classes.earlier(deal[stay], content[stay], d1[stay], at[stay])
            many = np.unique(j[~differs & ~twin])
            classes.add(deal[many], content[many], d1[many], at[many])
            gone = np.sort(np.concatenate((i[~differs & ~twin], stay[known])))
            stay = np.concatenate((stay[~known], i[differs]))
            fresh = np.flatnonzero(np.append(True, (of[gone][1:] != of[gone][:-1]) | (first[gone][1:] != first[gone][:-1] + count[gone][:-1]))) if len(gone) else gone
            g = gone[fresh]
            end = np.maximum.reduceat(first[gone] + count[gone], fresh) + length - 1 if len(gone) else g
            yield pa.record_batch({
                "deal": pa.array(np.append(deal[stay], mix(d1[g].view(np.uint64))).view(np.int64)), "content": pa.array(np.append(content[stay].view(np.int64), end - first[g])),
                "d1": pa.array(np.append(d1[stay], d1[g])), "at": pa.array(np.append(at[stay], (first[g] - offsets[of[g]] + base) << _COUNT_BITS)),
            })


@lean
def _resolve(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of _pieces sorted by (deal, content, d1, at) to removed stretches (deal null, d1, at, n) and pieces with a rival of other content (deal, d1, at, n null). Holds back one row only."""
    held = None  # the last row that leads its content and has met no rival yet: (deal, content, d1, at, rival)

    def out(deal: np.ndarray | None, d1: np.ndarray, at: np.ndarray, n: np.ndarray | None) -> pa.RecordBatch:
        nulls = pa.nulls(len(d1), pa.int64())
        return pa.record_batch({"deal": pa.array(deal) if deal is not None else nulls, "d1": pa.array(d1), "at": pa.array(at), "n": pa.array(n) if n is not None else nulls})

    for batch in batches:
        deal, content, d1, at = (batch.column(c).to_numpy() for c in ("deal", "content", "d1", "at"))
        ready = (at & 0xFF) == 0
        if ready.any():
            yield out(None, d1[ready], at[ready], content[ready])
            deal, content, d1, at = (x[~ready] for x in (deal, content, d1, at))
        if not len(deal):
            continue
        rival_before = False
        if held is not None:
            deal, content, d1, at = (np.append(np.array([v], np.int64), x) for v, x in zip(held[:4], (deal, content, d1, at), strict=True))
            rival_before = held[4]
        new_deal = np.append(True, deal[1:] != deal[:-1])
        lead = np.append(True, new_deal[1:] | (content[1:] != content[:-1]))
        at_lead = np.maximum.accumulate(np.where(lead, np.arange(len(deal)), 0))
        gone = ~lead & ~((d1 == d1[at_lead]) & (at == at[at_lead]))
        if gone.any():
            yield out(None, d1[gone], at[gone], (at[gone] & 0xFF) + length - 1)
        leads = np.flatnonzero(lead)
        group = np.cumsum(new_deal[leads]) - 1
        many = np.bincount(group)[group] > 1
        if rival_before:  # the held row has been told as a rival already; what follows of its minimizer are rivals too
            many |= group == 0
        told = many.copy()
        if rival_before:
            told[0] = False
        k = leads[told]
        if len(k):
            yield out(deal[k], d1[k], at[k], None)
        z = leads[-1]
        held = (deal[z], content[z], d1[z], at[z], bool(many[-1]))


class RunIndex:
    """A Burrows-Wheeler transform of strings, by its runs, with text positions sampled where runs start and end. The strings end in terminators, each smaller than the next one's and all smaller than any byte."""

    def __init__(self, strings: list[np.ndarray]) -> None:
        size = np.array([len(s) for s in strings], np.int64)
        stops = np.cumsum(size + 1) - 1
        text = np.zeros(int(stops[-1]) + 1 if len(strings) else 0, np.int64)
        text[np.delete(np.arange(len(text)), stops)] = np.concatenate(strings).astype(np.int64) + 1
        n = len(text)
        order = self._sort(text, stops)
        before = text[order - 1]  # order 0 looks at the last terminator
        bounds = runs(before)
        self.starts, self.symbols = bounds[:-1], before[bounds[:-1]]
        length = np.diff(bounds)
        smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=257))))
        by_symbol = np.lexsort((np.arange(len(length)), self.symbols))
        total = np.cumsum(length[by_symbol]) - length[by_symbol]
        head = np.maximum.accumulate(np.where(np.append(True, np.diff(self.symbols[by_symbol]) != 0), np.arange(len(by_symbol)), 0))
        self.jump = np.empty_like(length)  # where the first row of a run goes, one step to the left in the text
        self.jump[by_symbol] = smaller[self.symbols[by_symbol]] + total - total[head]
        self.ends = bounds[1:] - 1
        self.first, self.last = order[self.starts], order[self.ends]
        self.keys = self.symbols[by_symbol] * (len(length) + 1) + by_symbol  # sorted (symbol, run)
        self.runs_of = by_symbol
        self.text = np.concatenate((text, np.zeros(32, np.int64))).astype(np.int16)
        self.n = n

    @staticmethod
    def _sort(text: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Suffix array by doubling, from four symbols on. A terminator tells its string, so suffixes compare up to it."""
        n = len(text)
        padded = np.append(text, np.zeros(4, np.int64))
        string = np.searchsorted(stops, np.arange(n))
        left = stops[string] - np.arange(n)
        key = np.zeros(n, np.int64)
        for k in range(4):
            key = key << 9 | np.where(left >= k, padded[k : k + n], 0)
        key = key << 24 | np.where(left < 4, string + 1, 0)
        depth = 4
        while True:
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            fresh = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
            rank[order] = fresh
            if fresh[-1] == n - 1:
                return order
            ahead = np.arange(n) + depth
            key = rank << 32 | np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
            depth *= 2

    def _alike(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols from a and from b on are the same, at most `most`."""
        out = np.zeros(len(a), np.int64)
        left = np.flatnonzero(most > 0)
        step = np.arange(16)
        while len(left):
            x = self.text[np.minimum(a[left, None] + out[left, None] + step, self.n + 15)]
            y = self.text[np.minimum(b[left, None] + out[left, None] + step, self.n + 15)]
            differs = x != y
            some = differs.any(axis=1)
            out[left] += np.where(some, differs.argmax(axis=1), 16)
            left = left[~some & (out[left] < most[left])]
        return np.minimum(out, most)

    def matching_statistics(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each place of each pattern (bytes of data), the length of the longest match of what follows in the pattern: an array [pattern, place], read from the right end. All patterns are streamed side by side."""
        m, most = len(starts), int(sizes.max())
        out = np.zeros((m, most), np.int16)
        row, pos, length = np.zeros(m, np.int64), np.full(m, self.first[0]), np.zeros(m, np.int64)
        width = len(self.starts) + 1
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        for back in range(1, most + 1):
            live = int(np.searchsorted(-sizes, -back, "right"))
            c = data[starts[:live] + sizes[:live] - back].astype(np.int64) + 1
            run = np.searchsorted(self.starts, row[:live], "right") - 1
            good = self.symbols[run] == c
            bad = np.flatnonzero(~good)
            length[:live][good] += 1
            if len(bad):
                cb, rb, pb, lb = c[bad], run[bad], pos[bad], length[bad]
                k = np.searchsorted(self.keys, cb * width + rb)
                up, down = np.maximum(k - 1, 0), np.minimum(k, len(self.keys) - 1)
                has_up = (k > 0) & (self.keys[up] // width == cb)
                has_down = (k < len(self.keys)) & (self.keys[down] // width == cb)
                run_up, run_down = self.runs_of[up], self.runs_of[down]
                l_up = np.where(has_up, self._alike(pb, self.last[run_up], np.where(has_up, lb, 0)), -1)
                l_down = np.where(has_down, self._alike(pb, self.first[run_down], np.where(has_down, lb, 0)), -1)
                to_up = l_up >= l_down
                none = ~has_up & ~has_down
                chosen = np.where(to_up, run_up, run_down)
                row[bad] = np.where(to_up, self.ends[chosen], self.starts[chosen])
                pos[bad] = np.where(to_up, self.last[chosen], self.first[chosen])
                length[bad] = np.maximum(l_up, l_down) + 1
                run[bad] = chosen
                lost = bad[none]
                row[:live] = self.jump[run] + row[:live] - self.starts[run]
                pos[:live] -= 1
                row[lost], pos[lost], length[lost] = 0, self.first[0], 0
            else:
                row[:live] = self.jump[run] + row[:live] - self.starts[run]
                pos[:live] -= 1
            out[:live, back - 1] = length[:live]
        back = np.empty_like(out)
        back[order] = out
        return back


def earlier_windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(piece, windows of it) that occur in an earlier piece of the same group; pieces are in order of position within each group.

    The pieces of a group are numbered; for each bit of the number, those with the bit set are streamed over an index of those that agree on all higher bits and lack it. So each meets each earlier one once."""
    number = np.arange(len(starts)) - np.repeat(runs(group)[:-1], np.diff(runs(group)))
    found = []
    for bit in range(int(number.max()).bit_length() if len(number) else 0):
        block = number >> (bit + 1)
        high = (number >> bit) & 1 == 1
        for b in np.unique(block[high]):
            later = np.flatnonzero((block == b) & high)
            with_later = np.isin(group, group[later])
            earlier = np.flatnonzero((block == b) & ~high & with_later)
            index = RunIndex([data[starts[i] : starts[i] + sizes[i]] for i in earlier])
            lengths = index.matching_statistics(data, starts[later], sizes[later])
            for i, x in zip(later.tolist(), lengths, strict=True):
                w = np.flatnonzero(x[: sizes[i]][::-1] >= length)
                if len(w):
                    found.append((i, w))
    return found


@lean
def _match(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pieces (deal, d1, at, piece) sorted by (deal, d1, at) to removed stretches (d1, at, n)."""

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        keys = [table.column(c).to_numpy() for c in ("deal", "d1", "at")]
        fresh = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))  # rows that repeat doc_id and text bring each piece again
        table = table.filter(pa.array(fresh))
        pieces = table.column("piece").combine_chunks().cast(pa.large_binary())
        bounds = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, pieces.offset * 8)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        d1, at = table.column("d1").to_numpy(), table.column("at").to_numpy()
        i, w = [], []
        for k, windows in earlier_windows(data, bounds[:-1], np.diff(bounds), table.column("deal").to_numpy(), length):
            cut = np.append(0, np.flatnonzero(np.diff(windows) > 1) + 1)
            for a, b in zip(windows[cut], windows[np.append(cut[1:], len(windows)) - 1], strict=True):
                i.append(k)
                w.append((a, b - a + length))
        if not i:
            return None
        w = np.array(w, np.int64)
        return pa.record_batch({"d1": pa.array(d1[i]), "at": pa.array(at[i] + (w[:, 0] << _COUNT_BITS)), "n": pa.array(w[:, 1])})

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("piece").nbytes
        if size >= INDEX_BYTES:
            table = pa.Table.from_batches(held)
            deal = table.column("deal").to_numpy()
            cuts = runs(deal)
            sizes = np.cumsum(np.append(0, table.column("at").to_numpy() & 0xFF) + length)[cuts]
            a = 0
            while len(cuts) - 2 - a > 0:
                b = int(np.clip(np.searchsorted(sizes, sizes[a] + INDEX_BYTES, "right") - 1, a + 1, len(cuts) - 2))
                done = solve(table.slice(cuts[a], cuts[b] - cuts[a]))
                if done is not None:
                    yield done
                a = b
            rest = table.slice(cuts[a])
            held, size = rest.to_batches(), rest.column("piece").nbytes
    if held:
        done = solve(pa.Table.from_batches(held))
        if done is not None:
            yield done


@lean
def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            raw, offsets = text_bytes(part.column("text"))
            lists = part.column("want")
            rows, wants = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy()), lists.flatten()
            for k in range(0, len(rows), AT_ONCE):
                of, want = rows[k : k + AT_ONCE], wants.slice(k, AT_ONCE)
                at = want.field("at").to_numpy()
                start, size = offsets[of] + (at >> _COUNT_BITS), (at & 0xFF) + length - 1
                bounds = np.append(0, np.cumsum(size))
                data = raw[np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)]
                pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
                yield pa.record_batch({"deal": want.field("deal"), "d1": part.column("d1").take(pa.array(of)), "at": want.field("at"), "piece": pieces})


@lean
def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The windows of pieces (deal, d1, at, piece) by two hashes: (h1, h2, d1, at, n null) for the earliest of equal ones at hand, with 1 for its number of windows in `at`; the others are
    removed: stretches (d1, at, n)."""
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(k, AT_ONCE)
            pieces = part.column("piece").cast(pa.large_binary())
            bounds = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, pieces.offset * 8)
            grams = Grams(np.frombuffer(pieces.buffers()[2], np.uint8)[bounds[0] : bounds[-1]])
            at = part.column("at").to_numpy()
            count = at & 0xFF
            of = np.repeat(np.arange(len(at)), count)
            step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            start = bounds[of] - bounds[0] + step
            h1, h2 = (grams.spans(start, start + length, seed) for seed in (1, 2))
            places = (at[of] & ~np.int64(0xFF)) + (step << _COUNT_BITS) + 1
            d1 = part.column("d1").to_numpy()[of]
            order = np.lexsort((places, d1, h2, h1))
            a, b = h1[order], h2[order]
            lead = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            first = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
            gone = np.zeros(len(order), bool)
            gone[order] = ~lead & ~((d1[order] == d1[first]) & (places[order] == places[first]))
            stay = order[lead]
            g = np.flatnonzero(gone)
            fresh = np.append(True, (of[g][1:] != of[g][:-1]) | (step[g][1:] != step[g][:-1] + 1)) if len(g) else np.zeros(0, bool)
            heads = np.flatnonzero(fresh)
            size = np.diff(np.append(heads, len(g))) + length - 1
            empty = pa.nulls(len(heads), pa.int64())
            yield pa.record_batch({
                "h1": pa.concat_arrays([pa.array(h1[stay].view(np.int64)), empty]), "h2": pa.concat_arrays([pa.array(h2[stay].view(np.int64)), empty]),
                "d1": pa.array(np.append(d1[stay], d1[g[heads]])), "at": pa.array(np.append(places[stay], places[g[heads]])),
                "n": pa.concat_arrays([pa.nulls(len(stay), pa.int64()), pa.array(size.astype(np.int64))]),
            })


@lean
def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            raw, offsets = text_bytes(part.column("text"))
            n_removed, n_spans, kept = [], [], []
            for k, spans in enumerate(part.column("spans")):
                text = raw[offsets[k] : offsets[k + 1]]
                if spans.is_valid and len(spans):
                    start, n = (spans.values.field(c).to_numpy() for c in ("start", "n"))
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], np.maximum.accumulate((start + n)[order])
                    fresh = np.append(True, start[1:] > end[:-1])  # touching stretches are one
                    a, b = start[fresh], end[np.append(np.flatnonzero(fresh)[1:] - 1, len(end) - 1)]
                    n_removed.append(int((b - a).sum()))
                    n_spans.append(len(a))
                    kept.append(b"".join(text[x:y].tobytes() for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)))
                else:
                    n_removed.append(0)
                    n_spans.append(0)
                    kept.append(text.tobytes())
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})


def _numbered(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, d1, text), where d1 tells documents apart and orders them: doc_id, or where it is null or one has several texts in the table, a number of distinct (doc_id, text) in order."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hashes = base.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    several = hashes.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b")).where("doc_id IS NULL OR a <> b")
    if several.isEmpty():
        return base.select("doc_id", F.col("doc_id").alias("d1"), "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("doc_id"), F.asc("h1"), F.asc("h2")]
    numbers = materialize(hashes.distinct().repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("d1", F.monotonically_increasing_id()), "numbers")
    numbers = numbers.select(F.col("doc_id").alias("id"), "h1", "h2", "d1")
    keyed = base.select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    return materialize(keyed.join(numbers, ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "d1", "text"), "numbered", free=True)


def _start(at: Column) -> Column:
    return F.shiftright(at, _COUNT_BITS).alias("start")


def remove_repeats(docs: DataFrame, length: int = 100, most: int = SLICE_BYTES) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept binary): each text, as UTF-8 bytes, without the bytes that lie in a string of `length` bytes which also starts earlier:
    in a document with smaller doc_id, or earlier in the same one. Strings are judged on the input and never cross documents.

    n_spans counts maximal removed runs; kept holds the bytes left, which may cut a character. A null text is empty; documents without doc_id come before all others. Rows that repeat a doc_id
    with other texts are documents of their own in an arbitrary but fixed order, and so are rows without doc_id; rows that repeat doc_id and text are one document and each get its result. Texts of less than `length`
    bytes stay whole. An empty table gives no rows. Other columns are ignored. `length` is from 40 to 286; `most` bytes of text are cut into pieces at once, which changes no result.
    """
    if not GRAM + 8 <= length <= GRAM + 254:
        raise ValueError("length must be from 40 to 286")
    base = _numbered(docs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = base.select("d1", "text").mapInArrow(partial(_pieces, length=length, most=most), "deal long, content long, d1 long, at long")
    dealt = pieces.repartition(n, "deal").sortWithinPartitions("deal", "content", "d1", "at")
    known = materialize(dealt.mapInArrow(partial(_resolve, length=length), "deal long, d1 long, at long, n long"), "pieces", free=True)
    rivals = known.where("n IS NULL").select("deal", "d1", "at")
    gone = known.where("n IS NOT NULL").select("d1", "at", "n")
    by_doc = base.where("d1 IS NOT NULL").repartition(n, "d1")  # shuffled once: all joins read the same columns of it under the same filter, else Spark would shuffle the texts for each

    def cut(of: DataFrame) -> DataFrame:
        """The pieces of rows (deal, d1, at), with their bytes."""
        wanted = of.groupBy("d1").agg(F.collect_list(F.struct("deal", "at")).alias("want"))  # at most one for some 30 bytes of a document
        joined = by_doc.join(wanted.repartition(n, "d1"), "d1").select("doc_id", "d1", "text", "want")
        return joined.mapInArrow(partial(_cut_out, length=length), "deal long, d1 long, at long, piece binary")

    crowds = materialize(rivals.groupBy("deal").count().where(F.col("count") > CROWD).select("deal"), "crowds")
    few = rivals
    if not crowds.isEmpty():
        few = rivals.join(crowds, "deal", "left_anti")
        crowd = cut(rivals.join(crowds, "deal", "left_semi"))
        single = crowd.sortWithinPartitions("deal", "d1", "at").mapInArrow(partial(_windows, length=length), "h1 long, h2 long, d1 long, at long, n long")
        alone = single.where("n IS NULL").select("h1", "h2", "d1", "at")
        lead = alone.groupBy("h1", "h2").agg(F.min(F.struct("d1", "at")).alias("lead"), F.count("*").alias("c")).where("c > 1").select("h1", "h2", "lead")
        late = alone.join(lead, ["h1", "h2"]).where(F.struct("d1", "at") > F.col("lead")).select("d1", "at", F.lit(length).cast("long").alias("n"))
        gone = gone.unionByName(late).unionByName(single.where("n IS NOT NULL").select("d1", "at", "n"))
    matched = cut(few).repartition(n, "deal").sortWithinPartitions("deal", "d1", "at").mapInArrow(partial(_match, length=length), "d1 long, at long, n long")
    spans = gone.unionByName(matched).groupBy("d1").agg(F.collect_list(F.struct(_start(F.col("at")), "n")).alias("spans"))
    joined = by_doc.join(spans.repartition(n, "d1"), "d1", "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
