"""The registered queries of the engine's own operators, with the SQL that DuckDB gives the same rows for.

Articles are `documents`; items with a blank are made from every row of `benchmark`. The profile is the Latin one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import tokens as T
from .operators import candidates as C
from .operators import cooccurrence, corpus, counts, inspect, vectors
from .operators import screening as R
from .plans import build, evaluate, generate
from .profiles import LATIN as P
from .providers import AdjacentWords, InflectingTokenizer, NGramLM
from .sources import literal, readers, sinks, workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sentences(_docs(spark, sf_dir), P)


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.tagged(_docs(spark, sf_dir), P)


def _inflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with lemmas and detailed classes, and words that the dictionary lacks."""
    return build.tagged(_docs(spark, sf_dir), P, InflectingTokenizer())


def _vocabulary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.vocabulary_rows(_tagged(spark, sf_dir), P, "doc_id", "sent_no")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.word_frequencies(_vocabulary_rows(spark, sf_dir))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.corpus_rows(_tagged(spark, sf_dir), P, "doc_id", "sent_no")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.frequent_pairs(_corpus(spark, sf_dir), P.min_pair)


def _trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.frequent(counts.trigrams(_corpus(spark, sf_dir)), P.min_trigram)


def _deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.frequent(counts.dependencies(AdjacentWords(P.content).edges(_tagged(spark, sf_dir)), P), P.min_dependency)


def _stored(df: DataFrame) -> DataFrame:
    """For what several steps of a generator read."""
    return workspace.materialize(df, "stored")


class Counts:
    """Tables of one corpus for a query that needs several: it is tokenized once, into a table that all are counted from."""

    def __init__(self, spark: SparkSession, sf_dir: str, tokenizer=None) -> None:
        self.tokens = workspace.materialize(build.tagged(_docs(spark, sf_dir), P, tokenizer).select("toks"), "tokens")  # without what the folds give, which is as many words again
        self.corpus = counts.corpus_rows(self.tokens, P)
        self.trigrams = workspace.materialize(counts.frequent(counts.trigrams(self.corpus), P.min_trigram), "trigrams")
        self.lm = NGramLM(self.trigrams)

    def words(self) -> DataFrame:
        return workspace.materialize(counts.word_frequencies(counts.vocabulary_rows(self.tokens, P)), "words")

    def pairs(self) -> DataFrame:
        return workspace.materialize(cooccurrence.frequent_pairs(self.corpus, P.min_pair), "pairs")

    def dependencies(self) -> DataFrame:
        return counts.frequent(counts.dependencies(AdjacentWords(P.content).edges(self.tokens), P), P.min_dependency)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.make_items(build.tagged(_table(spark, sf_dir, "benchmark"), P, key="item_id"), P)


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.locate(_items(spark, sf_dir), P)


def word_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = counts.word_details(counts.vocabulary_rows(_inflected(spark, sf_dir), P))
    return d.select("lemma", "pos", F.array_join("surface_forms", " ").alias("surface_forms"), F.array_join("detailed_pos_tags", " ").alias("detailed_pos_tags"), "frequency", "unknown_by_dict_count")


def word_freq_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = _table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    return counts.merge_counts(_words(spark, sf_dir), counts.word_frequencies(counts.vocabulary_rows(build.tagged(more, P), P)))


def lookahead_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir).select("doc_id", "sent_no", F.posexplode("tokens").alias("k", "token"))
    return rows.withColumn("k", F.col("k").cast("long"))


def clean_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas with glosses made of the part table: names, types and brands behind a hyphen."""
    p = _table(spark, sf_dir, "part")
    raw = p.select("p_partkey", F.concat_ws("-", "p_name", F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, F.replace("p_type", F.lit(" "), F.lit(""))).otherwise("")).alias("lemma"))
    return raw.withColumn("cleaned", X.clean_lemma(F.col("lemma")))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that are searched for: those whose id is divisible by 100, as the set of queries; against all vectors."""
    e = _table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    context = F.when(F.col("label") % 3 == 0, "OPEN").when(F.col("label") % 3 == 1, "CLOSED")
    return e.select(F.col("vec_id").alias("item_id"), F.col("vec_id").cast("string").alias("word"), context.alias("context"))


def gen_cooc(contextual: bool, tokenizer=None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = Counts(spark, sf_dir, tokenizer)
        full, _ = generate.with_context(_items(spark, sf_dir), P, c.lm, tokenizer)
        return C.cooccurring(full, c.pairs(), c.words(), P, c.corpus.count(), contextual, tokenizer=tokenizer)

    return query


def _context(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return generate.with_context(_items(spark, sf_dir), P, NGramLM(workspace.materialize(_trigrams(spark, sf_dir), "trigrams")))


def gen_contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    full, probs = _context(spark, sf_dir)
    return C.masked(full, probs, P)


def context_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir)[0].select("item_id", "prev_word", "next_word", "entropy", "context")


def pll_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = build.tagged(_table(spark, sf_dir, "benchmark"), P, key="item_id").select("item_id", "sent_no", F.transform("toks", lambda t: t["sf"]).alias("words"))
    return R.pseudo_log_likelihood(sents, NGramLM(_stored(_trigrams(spark, sf_dir))), "item_id", "sent_no")


def _screened(spark: SparkSession, sf_dir: str, *which: str) -> DataFrame:
    c = Counts(spark, sf_dir)
    full, _ = generate.with_context(_items(spark, sf_dir), P, c.lm)
    rows = workspace.materialize(C.baseline(full, c.words()).drop("score"), "candidates")
    if "trigram" in which:
        rows = R.by_trigram(rows, full, c.trigrams)
    if "dependency" in which:
        rows = R.by_dependency(rows, full, c.dependencies(), AdjacentWords(P.content), P)
    if "pll" in which:
        rows = R.by_likelihood(rows, full, c.lm, P)
    return rows


def final_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.final(_screened(spark, sf_dir, "trigram", "dependency", "pll")).select("item_id", "rank", "word")


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    folder = workspace.folder(spark, "artefacts")
    build.build(_docs(spark, sf_dir), folder, P)
    a = build.load(spark, folder, P)
    items = _items(spark, sf_dir)
    context, _ = generate.with_context(items, P, NGramLM(a.trigrams))
    return context.select("item_id", "sentence", "target", "context"), generate.generate(items, a, P, n=30)


FLAGS = ("item_id", "system", "generator", "rank", "word", "score", "bad_trigram", "bad_dependency", "pll", "bad_pll")


def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)[1].select(*FLAGS)


def evaluation_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of both systems by the generators that need no trained vectors, which SQL can give too."""
    c = Counts(spark, sf_dir)
    a = build.Artefacts(c.words(), c.pairs(), c.trigrams, c.dependencies(), c.corpus.count())
    return generate.generate(_items(spark, sf_dir), a, P, n=30).select(*FLAGS)


def evaluation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of both systems, written as JSON lines and read again."""
    path = sinks.evaluation(evaluate.nest(*_evaluated(spark, sf_dir)), workspace.folder(spark, "evaluation"))
    return spark.read.text(path).select(F.get_json_object("value", "$.item_id").cast("long").alias("item_id"), F.col("value").alias("record"))


def article_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a folder of JSON lines: the documents in three files, and a file of two broken lines."""
    folder = workspace.folder(spark, "articles")
    sinks.json_lines(_table(spark, sf_dir, "documents").select("doc_id", "text").repartition(3, "doc_id").select("text"), f"{folder}/good")
    spark.createDataFrame([('{"text": "not closed',), ("no object",)], "value string").coalesce(1).write.text(f"{folder}/bad")
    lines = workspace.materialize(readers.articles(spark, folder, glob="part-*"), "lines")
    keyed = lines.where("NOT broken").select(F.monotonically_increasing_id().alias("doc_id"), "text")
    return corpus.file_counters(lines, corpus.sentences(keyed, P))


def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words counted from a file of one sentence a line."""
    path = workspace.folder(spark, "sentences")
    sinks.token_lines(_corpus(spark, sf_dir), path)
    return readers.token_lines(spark, path).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def csv_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a blank from a CSV file with quotes, commas and line ends within fields."""
    path = workspace.folder(spark, "items")
    rows = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit('a "___", '), "text").alias("sentence"), F.lit("t").alias("target"), F.concat("text", F.lit("\n,b")).alias("english_sentence"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return readers.cloze_items(spark, path)


def packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The details of the 200 most frequent words, written as one JSON object with packed keys and read again."""
    path = workspace.folder(spark, "words")
    d = counts.word_details(counts.vocabulary_rows(_inflected(spark, sf_dir), P))
    few = inspect.top(d, 200, "lemma", "pos", by="frequency").withColumn("details", F.struct("surface_forms", "detailed_pos_tags", "frequency", "unknown_by_dict_count"))
    sinks.packed_map(few, path, ["lemma", "pos"], "details")
    return readers.word_details(spark, path).select("lemma", "pos", F.array_join("surface_forms", " ").alias("surface_forms"), F.array_join("detailed_pos_tags", " ").alias("detailed_pos_tags"), "frequency", "unknown_by_dict_count")


def packed_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed keys with the separator in the last part: names of nations with their regions, of which there are few."""
    path = workspace.folder(spark, "nations")
    n = _table(spark, sf_dir, "nation").select("n_name", F.concat(F.col("n_regionkey").cast("string"), F.lit("|x")).alias("rest"), "n_nationkey")
    sinks.packed_map(n, path, ["n_name", "rest"], "n_nationkey")
    return readers.packed_map(spark, path, ["name", "rest"]).select("name", "rest", F.col("value").cast("long").alias("nationkey"))


def valid_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items as raw nodes of an analyzer: marks at both ends, blank surfaces, and short words without all features."""
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("sf"), F.lit("NOUN").alias("p"), w.alias("l"), F.lit("x").alias("d"), F.when(F.length(w) < 4, 6).otherwise(9).alias("n"), F.lit(0).alias("stat")))
    mark = lambda k: F.array(F.struct(F.lit("BOS/EOS").alias("sf"), F.lit("").alias("p"), F.lit("").alias("l"), F.lit("").alias("d"), F.lit(9).alias("n"), F.lit(k).alias("stat")))
    b = _table(spark, sf_dir, "benchmark").select("item_id", T.valid(F.concat(mark(2), words, mark(3))).alias("toks"))
    return b.select("item_id", T.wakati(F.col("toks")).alias("words"))


def w2v_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest words of the six most frequent ones, by a model of the whole corpus."""
    model = vectors.train(_corpus(spark, sf_dir))
    v = vectors.vectors(model)
    common = _corpus(spark, sf_dir).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(6)
    queries = common.select(F.xxhash64("word").alias("item_id"), "word")
    return C.similarity(queries, v, 3).join(queries.withColumnRenamed("word", "query"), "item_id").select("query", "rank", "word", "score")


QUERIES = {
    "sentence_split": _sents,
    "sentence_length_stats": lambda s, d: corpus.length_statistics(_sents(s, d)),
    "length_histogram": lambda s, d: corpus.length_histogram(_sents(s, d)),
    "long_sentences": lambda s, d: corpus.long_sentences(_sents(s, d), P),
    "reader_counters": lambda s, d: corpus.reader_counters(_docs(s, d), _sents(s, d)),
    "char_stats": lambda s, d: corpus.statistics(_docs(s, d), P),
    "word_freq": _words,
    "word_details": word_details,
    "word_freq_merge": word_freq_merge,
    "words_repeated": lambda s, d: _words(s, d).where("frequency > 1"),
    "top_words": lambda s, d: inspect.top(_words(s, d), 20, "lemma", "pos", by="frequency"),
    "pos_distribution": lambda s, d: counts.pos_distribution(_words(s, d)),
    "unknown_rate": lambda s, d: counts.unknown_rate(counts.word_details(counts.vocabulary_rows(_inflected(s, d), P))),
    "unknown_words": lambda s, d: counts.unknown_sample(counts.vocabulary_rows(_inflected(s, d), P, "doc_id", "sent_no"), _sents(s, d), "doc_id", "sent_no"),
    "vocabulary_sizes": lambda s, d: counts.vocabulary_sizes(_vocabulary_rows(s, d), _corpus(s, d)),
    "words_per_text": lambda s, d: counts.words_of_texts(_tagged(s, d), "doc_id"),
    "wakati": lambda s, d: _tagged(s, d).select("doc_id", "sent_no", T.wakati(F.col("toks")).alias("words")),
    "first_sentences": lambda s, d: readers.sampled(_sents(s, d), ["doc_id", "sent_no"], 1000),
    "fill_placeholders": lambda s, d: _items(s, d).select("item_id", X.fill_all(F.concat_ws(" / ", "sentence", "sentence"), F.col("target"), P).alias("filled"), X.fill_all(F.col("sentence"), F.lit("[MASK]"), P).alias("masked")),
    "valid_tokens": valid_tokens,
    "article_files": article_files,
    "token_lines": token_lines,
    "csv_items": csv_items,
    "packed_words": packed_words,
    "packed_nations": packed_nations,
    "literal_items": lambda s, d: C.locate(literal.items(s), P).select("item_id", "target", "lemma", "pos", "prev_word", "next_word"),
    "lookahead_tokens": lookahead_tokens,
    "vocab_tokens": lambda s, d: _vocabulary_rows(s, d).drop("detail", "unknown"),
    "pos_prefix_extract": lambda s, d: _tagged(s, d).select("doc_id", "sent_no", F.array_join(T.starting_with(F.col("toks"), "VE"), " ").alias("verbs")),
    "clean_lemma": clean_lemma,
    "cooc_totals": lambda s, d: cooccurrence.totals(_corpus(s, d), P.min_pair),
    "cooc_pruned": _pairs,
    "cooc_index": lambda s, d: counts.both_ways(_pairs(s, d)),
    "trigram_totals": lambda s, d: counts.totals(counts.trigrams(_corpus(s, d)), P.min_trigram),
    "trigram_pruned": _trigrams,
    "dep_pruned": _deps,
    "dep_index": lambda s, d: counts.relations_by_word(_deps(s, d)),
    "char_index": lambda s, d: counts.characters(_words(s, d)),
    "top_pairs": lambda s, d: inspect.top(_pairs(s, d), 20, "w1", "w2"),
    "bottom_pairs": lambda s, d: inspect.bottom(_pairs(s, d), 20, "w1", "w2"),
    "pairs_with_word": lambda s, d: inspect.pairs_with(_pairs(s, d), "of"),
    "trigrams_with_word": lambda s, d: inspect.sample(inspect.trigrams_with(_trigrams(s, d), "of"), 50, "w1", "w2", "w3"),
    "relations_with_word": lambda s, d: inspect.sample(inspect.relations_with(_deps(s, d), "inin"), 50, "dep", "head", "child"),
    "sample_trigrams": lambda s, d: inspect.sample(_trigrams(s, d), 20, "w1", "w2", "w3"),
    "sample_relations": lambda s, d: inspect.sample_by_word(counts.relations_by_word(_stored(_deps(s, d))), 20),
    "cloze_items": _items,
    "target_in_context": lambda s, d: _located(s, d).select("item_id", "target", "lemma", "pos"),
    "trigram_context": lambda s, d: _located(s, d).select("item_id", "prev_word", "next_word"),
    "gen_baseline": lambda s, d: C.baseline(_stored(_located(s, d)), _stored(_words(s, d))),
    "gen_spelling": lambda s, d: C.spelling(_stored(_located(s, d)), _stored(_words(s, d)), P),
    "gen_similarity": lambda s, d: C.similarity(_vector_queries(s, d), _vectors(s, d)),
    "gen_similarity_band": lambda s, d: C.similarity_in_band(_vector_queries(s, d), _vectors(s, d), P),
    "gen_cooc_pmi": gen_cooc(False),
    "gen_cooc_pmi_k": gen_cooc(True),
    "gen_cooc_lemma": gen_cooc(False, InflectingTokenizer()),
    "gen_contextual": gen_contextual,
    "context_class": context_class,
    "pll_scores": pll_scores,
    "filter_trigram": lambda s, d: _screened(s, d, "trigram"),
    "filter_dependency": lambda s, d: _screened(s, d, "dependency"),
    "filter_pll": lambda s, d: _screened(s, d, "pll"),
    "final_candidates": final_candidates,
    "evaluation_counted": evaluation_counted,
    "evaluation_rows": evaluation_rows,
    "evaluation_json": evaluation_json,
    "w2v_neighbours": w2v_neighbours,
}


def queries() -> dict:
    return dict(QUERIES)
