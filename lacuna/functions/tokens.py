"""Token arrays: the built-in tokenizer, and the look-ahead folds, row by row without a shuffle. The folds are made of Arrow batches, all tokens of a batch at once.

A token is struct(sf, p, l, d): surface, class, lemma and detailed class. A null lemma is the surface, * a word that the analyzer's dictionary lacks; a null detailed class is the class. Analyzers are providers (providers.py)
that give such arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..profiles import Profile

#: From the first letter between two spaces to the last.
WORD = "[a-zà-ɏ](?:[^ ]*[a-zà-ɏ])?"


def words(sentence: Column) -> Column:
    """Lower-cased words between spaces, without what isn't a letter at both ends; empty ones left out. One pass of one pattern over the sentence."""
    return F.regexp_extract_all(F.lower(sentence), F.lit(WORD), F.lit(0))


def word_class(word: Column) -> Column:
    """A stand-in for part of speech, by length and ending."""
    end, n = F.right(word, F.lit(2)), F.length(word)
    return (
        F.when(n.isin(1, 3), "PART").when(n == 2, "AUX").when(end.isin("ed", "er", "re", "en", "ar"), "VERB")
        .when(end.isin("ly", "al", "eu", "ie", "os"), "ADJ").otherwise("NOUN")
    )


def token(surface: Column, kind: Column, lemma: Column | None = None, detail: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(surface.alias("sf"), kind.alias("p"), (none if lemma is None else lemma).alias("l"), (none if detail is None else detail).alias("d"))


def tag(word_array: Column) -> Column:
    return F.transform(word_array, lambda w: token(w, word_class(w)))


def valid(nodes: Column, least_features: int = 8, marks: tuple[int, ...] = (2, 3)) -> Column:
    """Tokens of an analyzer's raw nodes struct(sf, p, l, d, n, stat): without blank surfaces, marks of the beginning and end of sentences (by stat), and nodes of too few features (n)."""
    fine = F.filter(nodes, lambda t: (F.trim(t["sf"]) != "") & ~t["stat"].isin(*marks) & (t["n"] >= least_features))
    return F.transform(fine, lambda t: token(t["sf"], t["p"], t["l"], t["d"]))


def wakati(tokens: Column) -> Column:
    """Surfaces with a space between."""
    return F.array_join(F.transform(tokens, lambda t: t["sf"]), " ")


def _column(tokens: pa.Array, name: str) -> pa.Array:
    return tokens.field(name).cast(pa.string())


def _said(mask: pa.Array, null: bool = False) -> np.ndarray:
    return pc.fill_null(mask, null).to_numpy(zero_copy_only=False)


def _runs(tokens: pa.Array, profile: Profile, excluded: tuple[str, ...]) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """All tokens of some sentences in one array, which of them begin an output token, and the surfaces of those. Left to right: a head class absorbs the auxiliaries that follow it at once; a blank surface or any other
    token ends the run. What a run absorbs stands behind its head, so surfaces grow by leaving out where the absorbed ones begin."""
    flat = tokens.flatten()
    surface, kind = _column(flat, "sf"), _column(flat, "p")
    sizes = pc.fill_null(tokens.value_lengths(), 0).to_numpy(zero_copy_only=False)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    solid = ~_said(pc.equal(pc.ascii_trim(surface, " "), ""))
    fine = solid & ~_said(pc.is_in(kind, pa.array(excluded, pa.string()))) & _said(pc.is_valid(kind))
    opens = fine & _said(pc.is_in(kind, pa.array(profile.heads, pa.string())))
    follows = solid & _said(pc.equal(kind, profile.auxiliary))
    last = np.maximum.accumulate(np.where(follows, -1, np.arange(len(flat)))) if len(flat) else start  # the token that a run of auxiliaries follows
    open_ = np.where(follows, opens | ((last >= start) & opens[last]), opens)
    absorbed = follows & (np.arange(len(flat)) > start) & np.append(False, open_[:-1])[: len(flat)]
    begins = fine & ~absorbed
    kept = surface.filter(pa.array(begins | absorbed))
    first = np.flatnonzero(begins[begins | absorbed])
    at = np.frombuffer(kept.buffers()[1], np.int32, len(kept) + 1, kept.offset * 4) if len(kept) else np.zeros(1, np.int32)
    valid = None
    if kept.null_count:
        valid = pa.array(np.logical_and.reduceat(_said(pc.is_valid(kept)), first), pa.bool_()).buffers()[1]
    surfaces = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(at[first], at[-1]).astype(np.int32)), kept.buffers()[2] or pa.py_buffer(b""), valid)
    return flat, begins, surfaces


def _nested(tokens: pa.Array, begins: np.ndarray, values: pa.Array) -> pa.Array:
    """values as lists, one for each sentence; null where it has no tokens at all."""
    ends = np.append(0, np.cumsum(pc.fill_null(tokens.value_lengths(), 0).to_numpy(zero_copy_only=False)))
    offsets = np.append(0, np.cumsum(begins))[ends].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pc.is_null(tokens) if tokens.null_count else None)


def corpus_tokens(tokens: Column, profile: Profile) -> Column:
    """array<string>: surfaces for co-occurrence, trigrams and vectors; an auxiliary on its own stays."""

    def fold(toks: pa.Array) -> pa.Array:
        _, begins, surfaces = _runs(toks, profile, profile.corpus_excluded)
        return _nested(toks, begins, surfaces)

    return arrow_udf(fold, "array<string>")(tokens)


def vocabulary_tokens(tokens: Column, profile: Profile) -> Column:
    """array<struct(lemma, pos, surface, detail, unknown)>: only the surface grows; an auxiliary on its own is left out."""

    def fold(toks: pa.Array) -> pa.Array:
        flat, begins, surfaces = _runs(toks, profile, profile.vocabulary_excluded)
        own, kind, lemma, detail = (_column(flat, c).filter(pa.array(begins)) for c in ("sf", "p", "l", "d"))
        bare = lambda x, *marks: pc.is_in(pc.ascii_trim(x, " "), pa.array(marks, pa.string()))
        lemma, unknown = pc.if_else(pc.or_(pc.is_null(lemma), bare(lemma, "", "*")), own, lemma), bare(lemma, "*")
        lemma = pc.if_else(bare(own, "", "*"), "", lemma)
        return _nested(toks, begins, pa.StructArray.from_arrays([lemma, kind, surfaces, pc.coalesce(detail, kind), unknown], ["lemma", "pos", "surface", "detail", "unknown"]))

    return arrow_udf(fold, "array<struct<lemma:string,pos:string,surface:string,detail:string,unknown:boolean>>")(tokens)


def adjacent(tokens: Column, kinds: tuple[str, ...]) -> Column:
    """array<struct(head, child, head_pos, child_pos)>: each token of some classes with the next one of them, by lemma or else surface."""

    def pairs(toks: pa.Array) -> pa.Array:
        flat = toks.flatten()
        sizes = pc.fill_null(toks.value_lengths(), 0).to_numpy(zero_copy_only=False)
        mine = _said(pc.is_in(_column(flat, "p"), pa.array(kinds, pa.string())))
        sf, kind, lemma = (_column(flat, c).filter(pa.array(mine)) for c in ("sf", "p", "l"))
        word = pc.if_else(pc.or_(pc.is_null(lemma), pc.is_in(pc.ascii_trim(lemma, " "), pa.array(["", "*"]))), sf, lemma)
        of = np.repeat(np.arange(len(sizes)), sizes)[mine]
        at = np.flatnonzero(of[1:] == of[:-1])
        a, b = pa.array(at), pa.array(at + 1)
        values = pa.StructArray.from_arrays([word.take(a), word.take(b), kind.take(a), kind.take(b)], ["head", "child", "head_pos", "child_pos"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[at], np.arange(len(sizes) + 1)).astype(np.int32)), values)

    return arrow_udf(pairs, "array<struct<head:string,child:string,head_pos:string,child_pos:string>>")(tokens)


def lemma_or_surface(lemma: Column, surface: Column) -> Column:
    """Analyzers write * or nothing for words that their dictionary lacks."""
    return F.when(F.coalesce(F.trim(lemma), F.lit("")).isin("", "*"), surface).otherwise(lemma)


def starting_with(tokens: Column, prefix: str) -> Column:
    """Surfaces of tokens whose class starts with prefix."""
    return F.transform(F.filter(tokens, lambda t: F.startswith(t["p"], F.lit(prefix))), lambda t: t["sf"])


def trigrams(tokens: Column) -> Column:
    """Runs of three, repeats included; none of fewer tokens."""
    index = F.sequence(F.lit(0), F.size(tokens) - 3)
    runs = F.transform(index, lambda i: F.struct(F.get(tokens, i).alias("w1"), F.get(tokens, i + 1).alias("w2"), F.get(tokens, i + 2).alias("w3")))
    return F.when(F.size(tokens) >= 3, runs)
