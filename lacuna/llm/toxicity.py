"""Toxicity: a logistic classifier whose scores are held alike when identity terms are swapped.

A text is the set of its words and of their beginnings of 4 to 6 bytes. Labelled texts that name a group get a twin in which each such term is swapped for another one of its list;
training adds a penalty on the squared difference of the two logits. So weight that a term carries only because it occurs in toxic texts goes to what those texts have besides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, coded_words, lean, materialize, parts_of

#: Lists of terms for groups of people; terms of one list are swapped for each other. A parameter of fit().
IDENTITY_TERMS = (
    "women men girls boys mothers fathers",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "africans americans asians europeans mexicans chinese",
    "black white asian latino arab indigenous",
    "gay straight lesbian bisexual transgender queer",
    "immigrants refugees natives foreigners migrants citizens",
    "disabled blind deaf autistic elderly young",
    "frauen männer mädchen jungen mütter väter",
    "muslime christen juden hindus buddhisten atheisten",
    "mujeres hombres niñas niños madres padres",
    "musulmanes cristianos judíos hindúes budistas ateos",
    "femmes hommes filles garçons mères pères",
    "musulmans chrétiens juifs hindous bouddhistes athées",
)
#: Bytes of words before lower-casing.
ALNUM_ANY_CASE = ALNUM[LOWER]
SLOTS = 1 << 20
#: Slots that the model has weights for, at most: the clearest ones.
FEATURES = 1 << 15
#: Labelled rows used for training, at most; which, a hash of doc_id decides.
LABELLED = 20_000
THRESHOLD = 0.7
_FAMILIES = ((0, 0x51ED270B), (4, 0x2545F491), (5, 0x27D4EB2F), (6, 0x165667B1))


def word_slots(words: list[bytes]) -> np.ndarray:
    """A row of slots per word: of the word, and of its first 4, 5 and 6 bytes where it has more, else the slot of the word again."""
    digest = xxhash.xxh3_64_intdigest
    out = np.empty((len(words), len(_FAMILIES)), np.int32)
    for k, (size, salt) in enumerate(_FAMILIES):
        out[:, k] = [digest(w[:size], salt) >> 44 if size and len(w) > size else digest(w, _FAMILIES[0][1]) >> 44 for w in words]
    return out


class Counterfactuals:
    """The slots of each identity term, and of the term that takes its place at a turn: the next one of its list, or one further on."""

    def __init__(self, terms: tuple[str, ...]) -> None:
        groups = [t.encode().split() for t in terms]
        self.place = {w: (g, i) for g, ws in enumerate(groups) for i, w in enumerate(ws)}
        self.groups = groups

    def swap(self, word: bytes, turn: int) -> bytes:
        g, i = self.place[word]
        n = len(self.groups[g])
        return self.groups[g][(i + 1 + turn % (n - 1)) % n]


@lean
def _examples(batches: Iterator[pa.RecordBatch], terms: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(label, slots, twin): the distinct slots of a text, and those of its counterfactual twin (empty without identity terms)."""
    swaps = Counterfactuals(terms)
    kind = pa.list_(pa.int32())
    own, twin = (np.zeros(0, np.int32),) * 2  # of the blocks so far of one long text
    named = False
    for batch in batches:
        for part, raw, offsets, first, last in parts_of(batch, ALNUM_ANY_CASE):
            coded, number, of = coded_words(LOWER[raw], offsets, ALNUM)
            words = coded.to_pylist()
            slots = word_slots(words)
            term = np.fromiter((w in swaps.place for w in words), bool, len(words))
            bounds = np.searchsorted(of, np.arange(len(offsets)))
            owns, twins = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                mine = np.unique(number[a:b])
                owns.append(np.unique(slots[mine]))
                swapped = mine[term[mine]]
                turn = len(mine)
                other = word_slots([swaps.swap(words[k], turn) for k in swapped])
                twins.append(np.unique(np.concatenate((slots[mine[~term[mine]]].ravel(), other.ravel()))) if len(swapped) or not (first and last) else np.zeros(0, np.int32))
                named = named and not first or bool(len(swapped))
            if not (first and last):
                own = np.union1d(own[:0] if first else own, owns[0])
                twin = np.union1d(twin[:0] if first else twin, twins[0])
                owns, twins = [own], [twin if named else twin[:0]]
            if last:
                yield pa.record_batch({"label": part.column("label"), "slots": pa.array(owns, kind), "twin": pa.array(twins, kind)})


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in lists], np.int64)
    return (np.concatenate(lists) if len(lists) else np.zeros(0, np.int64)).astype(np.int64), np.repeat(np.arange(len(lists)), size)


class Design:
    """Sparse 0/1 rows over the chosen slots."""

    def __init__(self, lists: list[np.ndarray], number: np.ndarray) -> None:
        slots, row = _flat(lists)
        keep = (slots >= 0) & (number[slots] >= 0)
        self.row, self.column, self.n, self.width = row[keep], number[slots[keep]], len(lists), int(number.max()) + 1

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=g[self.row], minlength=self.width)


def choose_slots(slot: np.ndarray, both: np.ndarray, bad: np.ndarray, n: int, n1: int, least: int = 4, clear: float = 12.0) -> np.ndarray:
    """A number for each slot that is in `least` texts or more and whose share differs between the labels by a G-test above `clear`, the FEATURES clearest if more, else -1.

    `slot` is in `both` texts, `bad` of them with label 1; of all n texts n1 have it."""
    both, bad = both.astype(float), bad.astype(float)
    expected1 = both * n1 / max(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda seen, want: np.where(seen > 0, seen * np.log(seen / want), 0.0)
        g = 2 * (term(bad, expected1) + term(both - bad, both - expected1) + term(n1 - bad, n1 - expected1) + term(n - n1 - both + bad, n - n1 - both + expected1))
    fit = np.flatnonzero((both >= least) & (g > clear))
    chosen = np.sort(slot[fit[np.lexsort((slot[fit], -g[fit]))][:FEATURES]])
    number = np.full(SLOTS, -1, np.int64)
    number[chosen] = np.arange(len(chosen))
    return number


def fit_weights(own: list[np.ndarray], twins: list[np.ndarray], label: np.ndarray, number: np.ndarray, pull: float = 1.0, ridge: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights by slot (number: see choose_slots) and an offset, so that a sigmoid of their sum is the score; the offset makes THRESHOLD the best cut of the training rows by errors.

    Minimizes mean log loss + ridge |w|^2 + pull * mean over texts with a twin of the squared difference of logits, by gradient steps with adaptive sizes."""
    weights = np.zeros(SLOTS)
    if not 0 < label.sum() < len(label):
        return weights, -10.0 if not label.sum() else 10.0
    if number.max() < 0:
        return weights, float(np.log(label.mean() / (1 - label.mean())))
    x = Design(own, number)
    swapped = [k for k, t in enumerate(twins) if len(t)]
    a, b = Design([own[k] for k in swapped], number), Design([twins[k] for k in swapped], number)
    w, w0 = np.zeros(x.width), float(np.log(label.mean() / (1 - label.mean())))
    m, v, m0, v0 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + w0, -30, 30)))
        g = x.back(p - label) / x.n + 2 * ridge * w
        if swapped:
            d = a.times(w) - b.times(w)
            g += 2 * pull * (a.back(d) - b.back(d)) / len(swapped)
        g0 = float((p - label).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        m0, v0 = 0.9 * m0 + 0.1 * g0, 0.99 * v0 + 0.01 * g0 * g0
        step = 0.1 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-9)
        w0 -= step * m0 / (np.sqrt(v0) + 1e-9)
    logit = x.times(w) + w0
    order = np.argsort(logit, kind="stable")
    z, y = logit[order], label[order]
    errors = np.concatenate(([0], np.cumsum(y))) + (len(y) - y.sum()) - np.concatenate(([0], np.cumsum(1 - y)))
    edges = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
    best = edges[np.lexsort((-np.concatenate(([0], np.diff(z), [0])), errors))[0]]
    weights[np.flatnonzero(number >= 0)] = w
    return weights, w0 - float(best) + float(np.log(THRESHOLD / (1 - THRESHOLD)))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, terms: tuple[str, ...] = IDENTITY_TERMS, pull: float = 1.0) -> tuple[np.ndarray, float]:
    """Fits on at most `labelled` rows of labels(doc_id, toxic) and their texts in docs(doc_id, text)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    known = materialize(known, "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    made = materialize(texts.mapInArrow(partial(_examples, terms=terms), "label int, slots array<int>, twin array<int>"), "examples")
    n, n1 = made.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counted = made.select("label", F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("n"), F.sum("label").alias("bad")).where("n >= 4").toPandas()  # at most SLOTS rows
    number = choose_slots(counted["slot"].to_numpy(np.int64), counted["n"].to_numpy(), counted["bad"].to_numpy(), n, n1)
    rows = made.mapInArrow(partial(_chosen, number=number), made.schema).toArrow()  # at most `labelled` rows of chosen slots
    own, twins = ([np.asarray(x) for x in rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)] if rows.num_rows else [] for c in ("slots", "twin"))
    return fit_weights(own, twins, rows.column("label").to_numpy().astype(float), number, pull)


def _chosen(batches: Iterator[pa.RecordBatch], number: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Examples with the chosen slots only. A twin that has nothing else has slot -1, so that it stays a twin."""
    kind = pa.list_(pa.int32())
    for batch in batches:
        lists = [[x[number[x] >= 0] for x in map(np.asarray, batch.column(c).to_numpy(zero_copy_only=False))] for c in ("slots", "twin")]
        had = batch.column("twin").value_lengths().to_numpy() > 0
        lists[1] = [x if len(x) or not h else np.full(1, -1, np.int32) for x, h in zip(lists[1], had, strict=True)]
        yield pa.record_batch({"label": batch.column("label"), "slots": pa.array(lists[0], kind), "twin": pa.array(lists[1], kind)})


@lean
def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray, offset: float) -> Iterator[pa.RecordBatch]:
    weights = weights.astype(np.float32)
    seen = np.zeros(0, np.int64)
    for batch in batches:
        for part, raw, offsets, first, last in parts_of(batch, ALNUM_ANY_CASE):
            coded, number, of = coded_words(LOWER[raw], offsets, ALNUM)
            slots = word_slots(coded.to_pylist())
            useful = (weights[slots] != 0).any(axis=1)[number]
            pairs = (of[useful, None] * SLOTS + slots[number[useful]]).ravel()
            seen = np.unique(pairs if first else np.concatenate((seen, pairs)))
            if last:
                logit = np.bincount(seen // SLOTS, weights=weights[seen % SLOTS], minlength=part.num_rows) + offset
                score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(score), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))})


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs(doc_id, text) to (doc_id, score, predicted), a row per document.

    Null and empty texts have no words and get the score of the offset alone. Repeated rows score alike; a null doc_id stays null; no rows give no rows. Labels of one kind only give a constant score. Other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_score, weights=model[0], offset=model[1]), "doc_id long, score double, predicted int")
