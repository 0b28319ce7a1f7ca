"""Token counts by a linear longest-match automaton.

The vocabulary's byte strings form a trie. A node that is no token has a failure link: where greedy longest matching would continue after it has taken its tokens off the front of
the node's string, and the precomputed number of these tokens. So a word is read once, byte by byte, and its number of pieces is known without building any piece. Many distinct words are read side by side with numpy.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, lean, parts_of, word_spans

#: Words that numpy steps are too costly for.
FEW = 64
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def read_vocabulary(path: str) -> list[bytes]:
    """The byte strings of a file of ranks, one base64 string and number a line."""
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line]


class Automaton:
    """Counts the pieces that greedy longest matching gives. All 256 single bytes must be tokens, so matching never gets stuck; empty tokens are ignored."""

    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        token = [False]
        for word in vocabulary:
            at = 0
            for c in word:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    token.append(False)
                at = nxt
            token[at] = at > 0
        if len(children[0]) < 256 or not all(token[v] for v in children[0].values()):
            raise ValueError("every single byte must be a token")
        fail, popped = [0] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in children[u].items():
                queue.append(v)
                if token[v]:
                    fail[v], popped[v] = 0, 1
                    continue
                z, n = fail[u], popped[u]
                while c not in children[z]:
                    n += popped[z]
                    z = fail[z]
                fail[v], popped[v] = children[z][c], n
        last = [0] * len(children)
        for v in range(1, len(children)):  # tokens popped when the word ends here; chains of links are short
            z, n = v, 0
            while z:
                n += popped[z]
                z = fail[z]
            last[v] = n
        self.fail, self.popped, self.last = np.array(fail, np.int32), np.array(popped, np.int32), np.array(last, np.int32)
        keys = np.array([u << 8 | c for u, x in enumerate(children) for c in x], np.uint64)
        values = np.array([v for x in children for v in x.values()], np.int32)
        self.children = self.links = None  # made where they are used
        self.bits = max(10, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)
        place = self._place(keys)
        left = np.arange(len(keys))
        while len(left):
            empty = self.keys[place[left]] == np.iinfo(np.uint64).max
            first = np.unique(place[left[empty]], return_index=True)[1]
            won = left[empty][first]
            self.keys[place[won]], self.values[place[won]] = keys[won], values[won]
            left = left[~np.isin(left, won)]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _goto(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by its byte, -1 where there is none."""
        keys = node.astype(np.uint64) << np.uint64(8) | byte
        place = self._place(keys)
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            found = self.keys[place[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[place[left[hit]]]
            left = left[~hit & (found != np.iinfo(np.uint64).max)]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
        return out

    def _walk(self, word: bytes, node: int, n: int) -> tuple[int, int]:
        """Where the rest of one word leads, and its pieces so far."""
        if self.children is None:
            full = np.flatnonzero(self.keys != np.iinfo(np.uint64).max)
            self.children = dict(zip(self.keys[full].tolist(), self.values[full].tolist(), strict=True))
            self.links = self.fail.tolist(), self.popped.tolist()
        children, (fail, popped) = self.children, self.links
        for c in word:
            while (nxt := children.get(node << 8 | c)) is None:
                n += popped[node]
                node = fail[node]
            node = nxt
        return node, n

    def count(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each of the words that lie one after another in data; ends are n + 1 offsets."""
        size = np.diff(ends)
        order = np.argsort(-size, kind="stable")
        start, size = ends[:-1][order], size[order]
        node, n = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        active = len(order)
        for t in range(int(size[0]) if len(size) else 0):
            active = int(np.searchsorted(-size[:active], -t, "left"))
            if active < FEW:  # the last of the long words, each by itself
                for k in range(active):
                    node[k], n[k] = self._walk(data[start[k] + t : start[k] + size[k]].tobytes(), int(node[k]), int(n[k]))
                break
            byte = data[start[:active] + t]
            nxt = self._goto(node[:active], byte)
            stuck = np.flatnonzero(nxt < 0)
            while len(stuck):
                n[stuck] += self.popped[node[stuck]]
                node[stuck] = self.fail[node[stuck]]
                nxt[stuck] = self._goto(node[stuck], byte[stuck])
                stuck = stuck[nxt[stuck] < 0]
            node[:active] = nxt
        n += self.last[node]
        out = np.empty_like(n)
        out[order] = n
        return out


@lean
def _counts(batches: Iterator[pa.RecordBatch], automaton: Automaton) -> Iterator[pa.RecordBatch]:
    sums = (np.zeros(1, np.int64),) * 2
    for batch in batches:
        for part, raw, offsets, first, last in parts_of(batch, NOT_SPACE):
            starts, ends, of = word_spans(raw, offsets, NOT_SPACE)
            # each word with one space before it, one after another
            size = ends - starts + 1
            at = np.concatenate(([0], np.cumsum(size)))
            data = np.full(at[-1], 0x20, np.uint8)
            data[np.delete(np.arange(at[-1]), at[:-1])] = raw[NOT_SPACE[raw]]
            words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
            distinct = words.dictionary
            bounds = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1) if len(distinct) else np.zeros(1, np.int64)
            pieces = automaton.count(np.frombuffer(distinct.buffers()[2], np.uint8) if len(distinct) else np.zeros(0, np.uint8), bounds)
            total = np.bincount(of, weights=pieces[words.indices.to_numpy()] if len(starts) else None, minlength=part.num_rows)
            more = np.bincount(of, minlength=part.num_rows), total.astype(np.int64)
            sums = more if first else (sums[0] + more[0], sums[1] + more[1])
            if last:
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_words": pa.array(sums[0]), "n_tokens": pa.array(sums[1])})


def count_tokens(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_words, n_tokens): words between white space, and the pieces of all words, each read with one space before it.

    Null and empty texts have none. Repeated rows count alike and each keeps its row; a null doc_id stays null; no rows give no rows. Other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_counts, automaton=automaton), "doc_id long, n_words long, n_tokens long")
