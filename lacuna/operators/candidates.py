"""Items with a blank, and generators of candidates for it: (item_id, rank, word, score) for all items at once.

Ties go by word, so results are the same in any partitioning. Items are few next to the vocabulary: joins are left to the optimizer, which broadcasts the smaller side where its size allows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..functions import tokens as T
from ..profiles import Profile
from ..providers import WordTokenizer, analyzed, token_info
from ..sources.workspace import materialize
from .counts import both_ways

OVERFETCH = 200
#: Vectors that are searched for at once, and rows that they are compared with at once.
QUERY_BLOCK, ROW_BLOCK = 1024, 4096


def make_items(tagged: DataFrame, profile: Profile, key: str = "item_id") -> DataFrame:
    """(key, sentence, target): of each text the first sentence with a word to ask for, from the middle on, and that word replaced by the placeholder."""
    askable = lambda i: (i >= F.floor(F.size("toks") / 2)) & ~F.get("toks", i)["p"].isin(*profile.vocabulary_excluded)
    at = F.when(F.size("toks") > 0, F.get(F.filter(F.sequence(F.lit(0), F.size("toks") - 1), askable), 0))
    found = tagged.withColumn("k", at).where("k IS NOT NULL").groupBy(key).agg(F.min_by(F.struct("toks", "k"), "sent_no").alias("x"))
    word = F.transform(F.col("x.toks"), lambda t, i: F.when(i == F.col("x.k"), profile.placeholder).otherwise(t["sf"]))
    return found.select(key, F.array_join(word, " ").alias("sentence"), F.get("x.toks", F.col("x.k"))["sf"].alias("target"))


def locate(items: DataFrame, profile: Profile, tokenizer=None) -> DataFrame:
    """items(item_id, sentence, target) with left and right (tokens around the blank), prev_word and next_word, and lemma and pos of the target in its context.

    The target is looked for where as many vocabulary tokens stand before it as before the blank, and taken if that surface contains it; else it is the first token with its surface; else lemma and pos are null. Without
    a blank all is null."""
    mark = profile.placeholder
    at = F.instr("sentence", mark)
    has = at > 0
    sides = {"left": F.substring("sentence", F.lit(1), at - 1), "right": F.substring("sentence", at + len(mark), F.length("sentence")), "_all": X.fill_first(F.col("sentence"), F.col("target"), profile)}
    rows = analyzed(items, "item_id", tokenizer or WordTokenizer(), **{name: F.when(has, text) for name, text in sides.items()})
    rows = rows.withColumn("_all", T.vocabulary_tokens(F.col("_all"), profile))
    before, after = T.corpus_tokens(F.col("left"), profile), T.corpus_tokens(F.col("right"), profile)
    there = F.get("_all", F.size(T.vocabulary_tokens(F.col("left"), profile)))
    same = F.get(F.filter("_all", lambda t: t["surface"] == F.col("target")), 0)
    info = F.when(F.contains(there["surface"], F.col("target")), there).otherwise(same)
    rows = rows.withColumn("prev_word", F.when(has, F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("BOS")))).withColumn("next_word", F.when(has, F.coalesce(F.get(after, 0), F.lit("EOS"))))
    return rows.withColumn("_info", info).withColumn("lemma", F.col("_info.lemma")).withColumn("pos", F.col("_info.pos")).drop("_all", "_info")


def ranked(scored: DataFrame, n: int, descending: bool = False) -> DataFrame:
    """The best n words per item of scored(item_id, lemma, word, score): words are cleaned of glosses, the best of each cleaned word stays, the target itself is left out."""
    score = F.desc("score") if descending else F.asc("score")
    clean = scored.withColumn("cleaned", X.clean_lemma(F.col("word")))
    one = clean.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "cleaned").orderBy(score, "word"))).where("r = 1")
    one = one.where(F.col("cleaned") != X.clean_lemma(F.col("lemma")))
    return best(one.select("item_id", F.col("cleaned").alias("word"), "score"), n, score)


def best(scored: DataFrame, n: int, score: Column | None = None) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score") if score is None else score, "word")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).select("item_id", "rank", "word", "score")


def _targets(items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return items.join(vocabulary.select("lemma", "pos", F.col("frequency").alias("target_frequency")), ["lemma", "pos"])


def _ladder(words: DataFrame, n: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    """words(keys, frequency, word) by rungs, the words of one frequency: (keys, frequency, word) with the first n + 1 of each rung, which are all that a list of n can take from it, and (keys, frequency, c), how many
    words a rung has for certain that no other rung has, too. Both are as large as there are different frequencies, not as the vocabulary."""
    clean = words.withColumn("cleaned", X.clean_lemma(F.col("word")))
    one = clean.groupBy(*keys, "frequency", "cleaned").agg(F.min("word").alias("word"))
    first = one.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "frequency").orderBy("cleaned"))).where(F.col("r") <= n + 1)
    return first.select(*keys, "frequency", "word"), clean.groupBy(*keys, "frequency").agg(F.count_if(F.col("word") == F.col("cleaned")).alias("c"))


def _closest(targets: DataFrame, words: DataFrame, n: int, *keys: str) -> DataFrame:
    """targets(item_id, lemma, keys, target_frequency) with the words of the same keys on the rungs that are closest in frequency: as many rungs as surely hold the best n."""
    ladder, rungs = (materialize(x, "rungs") for x in _ladder(words, n, *keys))
    asked = targets.select(*keys, "target_frequency").distinct().join(rungs, list(keys)).withColumn("d", S.frequency_distance(F.col("frequency"), F.col("target_frequency")).cast("long"))
    nearer = Window.partitionBy(*keys, "target_frequency").orderBy("d").rangeBetween(Window.unboundedPreceding, -1)
    near = asked.withColumn("before", F.coalesce(F.sum("c").over(nearer), F.lit(0))).where(F.col("before") < n + 1)
    found = near.join(ladder, [*keys, "frequency"]).select(*keys, "target_frequency", "word", F.col("d").cast("double").alias("score"))
    return targets.join(found, [*keys, "target_frequency"])


def baseline(items: DataFrame, vocabulary: DataFrame, n: int = 20) -> DataFrame:
    """Words of the target's class with the closest frequency."""
    words = vocabulary.where("frequency > 0").select("pos", F.col("lemma").alias("word"), "frequency")
    return ranked(_closest(_targets(items, vocabulary).select("item_id", "lemma", "pos", "target_frequency"), words, n, "pos"), n)


def spelling(items: DataFrame, vocabulary: DataFrame, profile: Profile, n: int = 20) -> DataFrame:
    """Those among them that share a character of the script with the target, by way of an index from characters to words."""

    def letters(rows: DataFrame, word: str) -> DataFrame:
        each = rows.withColumn("ch", F.explode(F.array_distinct(F.split(word, ""))))
        return each.where((X.script_count(F.col("ch"), profile) > 0) & ~F.col("ch").isin(*profile.ignored_characters or ("",)))

    targets = letters(_targets(items, vocabulary).select("item_id", "lemma", "pos", "target_frequency"), "lemma")
    words = letters(vocabulary.select("pos", F.col("lemma").alias("word"), "frequency"), "word")
    return ranked(_closest(targets, words, n, "pos", "ch"), n)


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows scaled to length 1; one that is null, without length or of another size than the first is all NaN."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy()
    width = int(sizes.max()) if len(sizes) else 0
    out = np.full((len(vectors), width), np.nan)
    whole = sizes == width
    flat = vectors.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(float)
    out[whole] = flat.reshape(-1, width) if width else out[whole]
    with np.errstate(divide="ignore", invalid="ignore"):
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def _block_best(batches: Iterator[pa.RecordBatch], item: np.ndarray, own: np.ndarray, asked: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """For each asked vector the k best rows of each block by cosine, with all that are equal to the last one up to rounding."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROW_BLOCK):
            rows = batch.slice(a, ROW_BLOCK)
            unit = _unit(rows.column("vec"))
            if unit.shape[1] != asked.shape[1]:
                continue
            word = np.array(rows.column("word").to_pylist(), object)
            cosine = asked @ unit.T
            cosine[np.isnan(cosine) | (own[:, None] == word[None, :])] = -np.inf
            last = np.partition(cosine, -k, axis=1)[:, -k] if len(word) > k else np.full(len(own), -np.inf)
            q, r = np.nonzero((cosine >= last[:, None] - 1e-6) & (cosine > -np.inf))
            yield pa.record_batch({"item_id": pa.array(item[q]), "word": pa.array(word[r], pa.string()), "score": pa.array(cosine[q, r])})


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """queries(item_id, word) against all vectors(word, vec): the k best (item_id, rank, word, score) of each by cosine, without its own word.

    Queries are taken in blocks of bounded size, each of which is compared with all vectors as matrices; of each block of rows only the k best travel."""
    mine = materialize(queries.join(vectors, "word").select("item_id", "word", F.col("vec").cast("array<double>").alias("vec"), F.xxhash64("item_id", "word").alias("_h")), "queries")
    blocks = mine.count() // QUERY_BLOCK + 1
    rows = vectors.select("word", F.col("vec").cast("array<double>").alias("vec"))
    out = None
    for b in range(blocks):
        block = mine.where(F.pmod("_h", F.lit(blocks)) == b).toArrow()  # about QUERY_BLOCK rows
        search = partial(_block_best, item=block.column("item_id").to_numpy().astype(np.int64), own=np.array(block.column("word").to_pylist(), object), asked=_unit(block.column("vec").combine_chunks()), k=k)
        found = rows.mapInArrow(search, "item_id long, word string, score double")
        out = found if out is None else out.unionByName(found)
    return best(out.withColumn("score", F.round("score", 6)), k)


def similarity(queries: DataFrame, vectors: DataFrame, n: int = 20) -> DataFrame:
    return nearest(queries, vectors, n)


def similarity_in_band(queries: DataFrame, vectors: DataFrame, profile: Profile, n: int = 20) -> DataFrame:
    """queries(item_id, word, context): the nearest 200 first, then the band of the context, then the best n."""
    near = nearest(queries, vectors, OVERFETCH).join(queries.select("item_id", "context"), "item_id")
    return best(near.where(S.in_band(F.col("context"), F.col("score"), profile.similarity_bands)).select("item_id", "word", "score"), n)


def with_vector(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """(item_id, word, context) of located items whose target was found in its sentence: the target if it has a vector, else its lemma if that has one."""
    known = vectors.select(F.col("word").alias("known"))
    either = items.where("lemma IS NOT NULL").select("item_id", "context", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("target").alias("word")), F.struct(F.lit(1).alias("k"), F.col("lemma").alias("word")))).alias("w"))
    have = either.join(known, F.col("w.word") == F.col("known"), "left_semi")
    return have.groupBy("item_id").agg(F.min_by("w.word", "w.k").alias("word"), F.any_value("context").alias("context"))


def cooccurring(items: DataFrame, pairs: DataFrame, vocabulary: DataFrame, profile: Profile, n_sentences: Column | int, contextual: bool, n: int = 20, tokenizer=None) -> DataFrame:
    """Words of the target's class found in sentences with it, by mutual information; with `contextual` by its square variant in OPEN contexts.

    Pairs are looked up by the target's surface, by its lemma only if the surface has none. What is found is analyzed by itself; of the surfaces of one lemma the one with the most common sentences stands for it."""
    targets = materialize(_targets(items, vocabulary), "targets")
    wanted = materialize(targets.select(F.explode(F.array("target", "lemma")).alias("word")).distinct(), "wanted")
    index = materialize(both_ways(pairs).join(wanted, "word", "left_semi"), "index")  # pairs are many, and read once only, beside a table that the optimizer knows to be small
    by_surface = targets.join(index, targets.target == index.word)
    none = targets.join(index.select(F.col("word").alias("target")).distinct(), "target", "left_anti")
    found = materialize(by_surface.unionByName(none.join(index, none.lemma == index.word)).select("item_id", "lemma", "pos", "context", "target_frequency", "other", "cnt", *([] if isinstance(n_sentences, int) else [n_sentences.alias("n_sentences")])), "found")
    info = token_info(found.select(F.col("other").alias("word")), tokenizer or WordTokenizer(), profile).select(F.col("word").alias("other"), F.col("lemma").alias("other_lemma"), "pos")
    known = found.join(info, ["other", "pos"])
    known = known.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "other_lemma").orderBy(F.desc("cnt"), "other"))).where("r = 1")
    words = vocabulary.select(F.col("lemma").alias("other_lemma"), "pos", "frequency")
    known = known.join(words, ["other_lemma", "pos"]).where(F.col("other_lemma") != F.col("lemma"))
    args = (F.col("cnt"), F.col("target_frequency"), F.col("frequency"), F.lit(n_sentences) if isinstance(n_sentences, int) else F.col("n_sentences"))
    score = S.by_context(F.col("context"), *args) if contextual else S.pmi(*args)
    scored = known.select("item_id", "lemma", F.col("other_lemma").alias("word"), F.round(score, 6).alias("score")).where("score IS NOT NULL")
    return ranked(scored, n, descending=True)


def probabilities(distribution: DataFrame) -> DataFrame:
    """(item_id, token, prob) of (item_id, token, logit): softmax per item."""
    w = Window.partitionBy("item_id")
    shifted = distribution.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return shifted.select("item_id", "token", (F.col("e") / F.sum("e").over(w)).alias("prob"))


def contexts(probs: DataFrame, profile: Profile) -> DataFrame:
    """(item_id, entropy, context) by the entropy of the mask's distribution, natural logarithm."""
    h = probs.groupBy("item_id").agg(F.round(-F.sum(F.when(F.col("prob") > 0, F.col("prob") * F.log("prob")).otherwise(0.0)), 6).alias("entropy"))
    return h.withColumn("context", S.context_class(F.col("entropy"), profile.open_entropy))


def masked(items: DataFrame, probs: DataFrame, profile: Profile, n: int = 20) -> DataFrame:
    """items(item_id, target, context): the likeliest 200 words in the blank, then the band of the context, without the target, word parts and unknown, then the best n."""
    rows = best(probs.select("item_id", F.col("token").alias("word"), F.round("prob", 6).alias("score")), OVERFETCH).join(items.select("item_id", "target", "context"), "item_id")
    fine = (F.col("word") != F.col("target")) & ~F.startswith("word", F.lit("##")) & (F.col("word") != "[UNK]")
    return best(rows.where(fine & S.in_band(F.col("context"), F.col("score"), profile.probability_bands)).select("item_id", "word", "score"), n)
