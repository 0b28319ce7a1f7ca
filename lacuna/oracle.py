"""The registered queries in DuckDB SQL, put together from common table expressions."""

from __future__ import annotations

from .sources.literal import ITEMS as ITEMS_IN_CODE

SCRIPT = r"[A-Za-z\x{00C0}-\x{024F}]"
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
EDGE = r"^[^a-z\x{00E0}-\x{024F}]+|[^a-z\x{00E0}-\x{024F}]+$"


def sentences(name: str, table: str, key: str) -> str:
    return rf"""
{name}_n AS (SELECT {key} AS key, trim(regexp_replace(text, '{BLANK}+', ' ', 'g')) AS t FROM {table}),
{name}_p AS (SELECT key, unnest(regexp_split_to_array(t, '[.!?]')) AS s, generate_subscripts(regexp_split_to_array(t, '[.!?]'), 1) - 1 AS sent_no FROM {name}_n WHERE length(t) >= 3),
{name} AS (SELECT key, sent_no, trim(s) AS sent, length(trim(s)) AS len FROM {name}_p
  WHERE length(trim(s)) BETWEEN 8 AND 300 AND len(regexp_extract_all(s, '{SCRIPT}')) / length(trim(s)) >= 0.3)"""


def word_class(w: str) -> str:
    return (
        f"CASE WHEN length({w}) IN (1, 3) THEN 'PART' WHEN length({w}) = 2 THEN 'AUX' WHEN right({w}, 2) IN ('ed', 'er', 're', 'en', 'ar') THEN 'VERB' "
        f"WHEN right({w}, 2) IN ('ly', 'al', 'eu', 'ie', 'os') THEN 'ADJ' ELSE 'NOUN' END"
    )


def lemma(w: str) -> str:
    """The lemma of the inflecting tokenizer, * where its dictionary lacks the word."""
    return f"""CASE WHEN regexp_matches({w}, '[^a-z]') THEN '*'
  WHEN length({w}) > 5 AND (({word_class(w)} = 'VERB' AND right({w}, 2) IN ('ed', 'er')) OR ({word_class(w)} = 'ADJ' AND right({w}, 2) = 'ly')) THEN left({w}, length({w}) - 2) ELSE {w} END"""


def tokens(name: str, source: str, keys: str = "key, sent_no", inflected: bool = False) -> str:
    more = f", {lemma('w[i]')} AS l, concat({word_class('w[i]')}, '-', right(w[i], 1)) AS d" if inflected else ", NULL AS l, NULL AS d"
    return rf"""
{name}_w AS (SELECT {keys}, list_filter(list_transform(string_split(sent, ' '), lambda w: regexp_replace(lower(w), '{EDGE}', '', 'g')), lambda w: w <> '') AS w FROM {source}),
{name} AS (SELECT {keys}, i, w[i] AS sf, {word_class("w[i]")} AS p{more} FROM (SELECT {keys}, w, unnest(range(1, len(w) + 1)) AS i FROM {name}_w))"""


def folded(name: str, source: str, keys: str = "key, sent_no", loose: bool = True) -> str:
    """Look-ahead tokens as gaps and islands: auxiliaries right behind a head go with it."""
    out = "'PART'" if loose else "'PART', 'AUX'"
    return f"""
{name}_a AS (SELECT *, last_value(CASE WHEN p <> 'AUX' THEN p END IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY i) AS anchor FROM {source}),
{name}_c AS (SELECT *, p = 'AUX' AND coalesce(anchor, '') IN ('VERB', 'ADJ') AS eaten FROM {name}_a),
{name}_g AS (SELECT *, sum(CASE WHEN eaten THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY i) AS g FROM {name}_c WHERE eaten OR p NOT IN ({out})),
{name} AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY g) - 1 AS k, lemma, pos, token, detail, unknown FROM
  (SELECT {keys}, g, first(coalesce(nullif(l, '*'), sf) ORDER BY i) AS lemma, first(p ORDER BY i) AS pos, string_agg(sf, '' ORDER BY i) AS token, first(coalesce(d, p) ORDER BY i) AS detail,
    first(coalesce(l = '*', false) ORDER BY i) AS unknown FROM {name}_g GROUP BY {keys}, g))"""


SENT = sentences("sent", "documents", "doc_id")
TOK = f"{SENT},{tokens('tok', 'sent')}"
VOC_INFLECTED = f"""{SENT},{tokens('tok', 'sent', inflected=True)},{folded('vt', 'tok', loose=False)}"""
DETAILS = """SELECT lemma, pos, string_agg(DISTINCT token, ' ' ORDER BY token) AS surface_forms, string_agg(DISTINCT detail, ' ' ORDER BY detail) AS detailed_pos_tags, count(*) AS frequency,
  CAST(count(*) FILTER (unknown) AS BIGINT) AS unknown_by_dict_count FROM vt GROUP BY lemma, pos"""
VOC = f"{TOK},{folded('vt', 'tok', loose=False)},\nvoc AS (SELECT lemma, pos, CAST(count(*) AS BIGINT) AS frequency FROM vt GROUP BY lemma, pos)"
_CT = folded("ct", "tok")
COR = f"{TOK},{_CT}"
_PAIRS = """
u AS (SELECT DISTINCT key, sent_no, token FROM ct),
allpairs AS (SELECT a.token AS w1, b.token AS w2, CAST(count(*) AS BIGINT) AS cnt FROM u a JOIN u b ON a.key = b.key AND a.sent_no = b.sent_no AND a.token < b.token GROUP BY 1, 2),
pairs AS (SELECT * FROM allpairs WHERE cnt >= 5)"""
_TRI = """
lead3 AS (SELECT token AS w1, lead(token) OVER w AS w2, lead(token, 2) OVER w AS w3 FROM ct WINDOW w AS (PARTITION BY key, sent_no ORDER BY k)),
alltri AS (SELECT w1, w2, w3, CAST(count(*) AS BIGINT) AS cnt FROM lead3 WHERE w3 IS NOT NULL GROUP BY 1, 2, 3),
tri AS (SELECT * FROM alltri WHERE cnt >= 2)"""
_DEP = """
dn AS (SELECT sf AS head, lead(sf) OVER (PARTITION BY key, sent_no ORDER BY i) AS child FROM tok WHERE p IN ('NOUN', 'PROPN', 'VERB', 'ADJ', 'ADV')),
dep AS (SELECT 'next' AS dep, head, child, CAST(count(*) AS BIGINT) AS cnt FROM dn WHERE child IS NOT NULL GROUP BY 2, 3 HAVING count(*) >= 3)"""
PAIRS, TRI, DEP = f"{COR},{_PAIRS}", f"{COR},{_TRI}", f"{TOK},{_DEP}"


def item_tokens(inflected: bool = False) -> str:
    return f"{sentences('isent', 'benchmark', 'item_id')},{tokens('itok', 'isent', inflected=inflected)}"


#: it: every token of an item's sentence, with its side of the blank; items: the items.
_PICK = """
pick AS (SELECT key, sent_no, min(i) AS k FROM (SELECT *, max(i) OVER (PARTITION BY key, sent_no) AS n FROM itok) WHERE i - 1 >= floor(n / 2) AND p NOT IN ('PART', 'AUX') GROUP BY key, sent_no),
one AS (SELECT * FROM pick QUALIFY row_number() OVER (PARTITION BY key ORDER BY sent_no) = 1),
it AS (SELECT t.key, t.sent_no, t.i, t.sf, t.p, t.l, t.d, o.k, CASE WHEN t.i < o.k THEN 'L' WHEN t.i > o.k THEN 'R' ELSE 'T' END AS side FROM itok t JOIN one o ON t.key = o.key AND t.sent_no = o.sent_no),
items AS (SELECT key AS item_id, string_agg(CASE WHEN side = 'T' THEN '___' ELSE sf END, ' ' ORDER BY i) AS sentence, max(CASE WHEN side = 'T' THEN sf END) AS target FROM it GROUP BY key)"""
_LOCATE = f"""
sides AS (SELECT * FROM it WHERE side <> 'T'),{folded('sc', 'sides', 'key, side')},{folded('sv', 'sides', 'key, side', loose=False)},{folded('av', 'it', 'key', loose=False)},
nl AS (SELECT key, count(*) AS n FROM sv WHERE side = 'L' GROUP BY key),
prv AS (SELECT key, last(token ORDER BY k) AS w FROM sc WHERE side = 'L' GROUP BY key), nxt AS (SELECT key, first(token ORDER BY k) AS w FROM sc WHERE side = 'R' GROUP BY key),
there AS (SELECT i.item_id, a.lemma, a.pos FROM items i LEFT JOIN nl ON nl.key = i.item_id JOIN av a ON a.key = i.item_id AND a.k = coalesce(nl.n, 0) WHERE contains(a.token, i.target)),
same AS (SELECT i.item_id, first(a.lemma ORDER BY a.k) AS lemma, first(a.pos ORDER BY a.k) AS pos FROM items i JOIN av a ON a.key = i.item_id AND a.token = i.target GROUP BY i.item_id),
loc AS (SELECT i.*, coalesce(prv.w, 'BOS') AS prev_word, coalesce(nxt.w, 'EOS') AS next_word, coalesce(t.lemma, s.lemma) AS lemma, coalesce(t.pos, s.pos) AS pos FROM items i
  LEFT JOIN prv ON prv.key = i.item_id LEFT JOIN nxt ON nxt.key = i.item_id LEFT JOIN there t ON t.item_id = i.item_id LEFT JOIN same s ON s.item_id = i.item_id)"""
_ITEM_TOK = item_tokens()
ITEMS = f"{_ITEM_TOK},{_PICK}"
LOCATED = f"{ITEMS},{_LOCATE}"


def clean(x: str) -> str:
    rest = f"substr({x}, instr({x}, '-') + 1)"
    return f"CASE WHEN instr({x}, '-') > 0 AND {rest} <> '' AND len(regexp_extract_all({rest}, '[A-Za-z]')) >= 0.8 * length({rest}) THEN substr({x}, 1, instr({x}, '-') - 1) ELSE {x} END"


def ranked(name: str, source: str, order: str, n: int = 20) -> str:
    return f"""
{name}_1 AS (SELECT *, {clean('word')} AS cleaned FROM {source}),
{name}_2 AS (SELECT * FROM {name}_1 QUALIFY row_number() OVER (PARTITION BY item_id, cleaned ORDER BY score {order}, word) = 1),
{name} AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score {order}, cleaned) AS rank, cleaned AS word, score FROM {name}_2 WHERE cleaned <> {clean('lemma')} QUALIFY rank <= {n})"""


_TARGETS = "tg AS (SELECT l.*, v.frequency AS tf FROM loc l JOIN voc v ON l.lemma = v.lemma AND l.pos = v.pos)"
_SAME = f"{_TARGETS},\npool AS (SELECT tg.*, v.lemma AS word, CAST(abs(v.frequency - tf) AS DOUBLE) AS score FROM tg JOIN voc v ON v.pos = tg.pos AND v.lemma <> tg.lemma)"
_LETTERS = "list_filter(string_split(%s, ''), lambda c: regexp_matches(c, '" + SCRIPT + "'))"
BASE = f"{VOC},{LOCATED},\n{_SAME},{ranked('base', 'pool', 'ASC')}"
_MASK = """
logits AS (SELECT l.item_id, t.w2 AS token, ln(t.cnt + 1) AS logit FROM loc l JOIN tri t ON t.w1 = l.prev_word AND t.w3 = l.next_word),
ex AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY item_id)) AS e FROM logits),
probs AS (SELECT item_id, token, e / sum(e) OVER (PARTITION BY item_id) AS prob FROM ex),
ent AS (SELECT item_id, round(-sum(prob * ln(prob)), 6) AS entropy FROM probs GROUP BY item_id),
ctx AS (SELECT l.*, entropy, CASE WHEN entropy IS NULL THEN NULL WHEN entropy > 1.0 THEN 'OPEN' ELSE 'CLOSED' END AS context FROM loc l LEFT JOIN ent USING (item_id))"""
_FULL = f"{VOC},{_CT},{_TRI},{LOCATED},{_MASK}"
MASK = f"{COR},{_TRI},{LOCATED},{_MASK}"
_LP = """
side2 AS (SELECT w1, w3, sum(cnt) AS n FROM tri GROUP BY w1, w3)"""


def pll(name: str, source: str, keys: str) -> str:
    """Of source(keys, i, w): the words of sentences in order."""
    joined = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_s AS (SELECT {keys}, w, coalesce(lag(w) OVER q, 'BOS') AS a, coalesce(lead(w) OVER q, 'EOS') AS b FROM {source} WINDOW q AS (PARTITION BY {keys} ORDER BY i)),
{name} AS (SELECT {joined}, round(sum(ln((coalesce(t.cnt, 0) + 1) / (coalesce(s2.n, 0) + 10000))), 6) AS pll FROM {name}_s s LEFT JOIN tri t ON t.w1 = s.a AND t.w2 = s.w AND t.w3 = s.b LEFT JOIN side2 s2 ON s2.w1 = s.a AND s2.w3 = s.b GROUP BY {joined})"""


def cooc(contextual: bool, inflected: bool = False, name: str = "res", n: int = 20) -> str:
    """Without the tables before: see COOC_BASE."""
    pmi = "log2((cnt / n) / ((tf / n) * (frequency / n)))"
    score = f"CASE WHEN context = 'OPEN' THEN {pmi} + log2(cnt / n) ELSE {pmi} END" if contextual else pmi
    own = f"coalesce(nullif({lemma('fd.other')}, '*'), fd.other)" if inflected else "fd.other"
    return f"""
{name}_ol AS (SELECT fd.*, {own} AS ol FROM fd WHERE {word_class('fd.other')} = fd.pos),
{name}_o1 AS (SELECT * FROM {name}_ol QUALIFY row_number() OVER (PARTITION BY item_id, ol ORDER BY cnt DESC, other) = 1),
{name}_kn AS (SELECT o.item_id, o.lemma, o.ol AS word, round({score}, 6) AS score FROM {name}_o1 o JOIN voc v ON v.lemma = o.ol AND v.pos = o.pos, ns WHERE o.ol <> o.lemma),{ranked(name, name + '_kn', 'DESC', n)}"""


#: What cooc() needs.
_COOC = f"""{_PAIRS},
ctg AS (SELECT c.*, v.frequency AS tf FROM ctx c JOIN voc v ON c.lemma = v.lemma AND c.pos = v.pos),
ix AS (SELECT w1 AS word, w2 AS other, cnt FROM pairs UNION ALL SELECT w2, w1, cnt FROM pairs),
ns AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM (SELECT DISTINCT key, sent_no FROM ct)),
fd AS (SELECT ctg.*, ix.other, ix.cnt FROM ctg JOIN ix ON ix.word = ctg.target
  UNION ALL SELECT ctg.*, ix.other, ix.cnt FROM ctg JOIN ix ON ix.word = ctg.lemma WHERE ctg.target NOT IN (SELECT word FROM ix))"""
_INFLECTED = f"""{VOC_INFLECTED},\nvoc AS (SELECT lemma, pos, CAST(count(*) AS BIGINT) AS frequency FROM vt GROUP BY lemma, pos),{_CT},{_TRI},{item_tokens(True)},{_PICK},{_LOCATE},{_MASK}"""


_DIM = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
NEAR = f"""
qs AS (SELECT vec_id AS item_id, vec_id, embedding, CASE WHEN label % 3 = 0 THEN 'OPEN' WHEN label % 3 = 1 THEN 'CLOSED' END AS context FROM embeddings WHERE vec_id % 100 = 0),
near AS (SELECT q.item_id, q.context, CAST(e.vec_id AS VARCHAR) AS word, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM qs q JOIN embeddings e ON e.vec_id <> q.vec_id)"""
_TOPN = "row_number() OVER (PARTITION BY item_id ORDER BY score DESC, word) AS rank"

_FLAG_TRI = "bt AS (SELECT b.item_id, b.rank, b.word, coalesce((SELECT true FROM tri t WHERE t.w1 = l.prev_word AND t.w2 = b.word AND t.w3 = l.next_word), false) AS bad_trigram FROM base b JOIN ctx l USING (item_id))"
_CANDS = """
full_c AS (SELECT b.item_id, b.word, i.i, CASE WHEN i.side = 'T' THEN b.word ELSE i.sf END AS w FROM base b JOIN it i ON i.key = b.item_id),
full_t AS (SELECT key AS item_id, i, sf AS w FROM it)"""
_FLAG_DEP = f"""
cp AS (SELECT *, {word_class('w')} AS p FROM full_c),
own AS (SELECT item_id, word, coalesce(first(w ORDER BY i) FILTER (w = word), first(w ORDER BY i) FILTER (p IN ('VERB', 'ADJ') AND starts_with(word, w)), word) AS own FROM cp GROUP BY item_id, word),
ce AS (SELECT item_id, word, w AS head, lead(w) OVER (PARTITION BY item_id, word ORDER BY i) AS child FROM cp WHERE p IN ('NOUN', 'PROPN', 'VERB', 'ADJ', 'ADV')),
bd AS (SELECT DISTINCT ce.item_id, ce.word FROM ce JOIN own USING (item_id, word) JOIN dep d ON d.head = ce.head AND d.child = ce.child WHERE ce.head = own OR ce.child = own)"""
_FLAG_PLL = f"{_LP},{pll('pc', 'full_c', 'item_id, word')},{pll('pt', 'full_t', 'item_id')}"
SCREEN = f"{_FULL},\n{_SAME},{ranked('base', 'pool', 'ASC')},{_CANDS},{_DEP},{_FLAG_DEP},{_FLAG_PLL},\n{_FLAG_TRI}"
_BAD_PLL = "NOT coalesce(pc.pll <= round(pt.pll - CASE WHEN c.context = 'OPEN' THEN 0.25 ELSE 0.1 END, 6), false)"



def drawn(*keys: str) -> str:
    return f"md5(concat_ws('|', 1, {', '.join(keys)})), {', '.join(keys)}"


def _literal() -> str:
    return ", ".join(f"({i}, '{s}', '{t}')" for i, (s, t) in enumerate(ITEMS_IN_CODE, 1))


def masked(name: str, n: int) -> str:
    return f"""
{name}_t AS (SELECT item_id, token AS word, round(prob, 6) AS score FROM probs QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(prob, 6) DESC, token) <= 200),
{name}_f AS (SELECT t.* FROM {name}_t t JOIN ctx c USING (item_id) WHERE word <> c.target AND NOT starts_with(word, '##') AND word <> '[UNK]'
  AND score BETWEEN 0.005 AND CASE c.context WHEN 'OPEN' THEN 0.5 WHEN 'CLOSED' THEN 0.9 ELSE 0.95 END),
{name} AS (SELECT item_id, {_TOPN}, word, score FROM {name}_f QUALIFY rank <= {n})"""


_SHARE = f"share AS (SELECT * FROM pool WHERE list_has_any({_LETTERS % 'lemma'}, {_LETTERS % 'word'}))"
_GENERATORS = (("plain", "baseline", "g1"), ("plain", "spelling", "g2"), ("plain", "cooccurrence", "g3"), ("contextual", "baseline", "g1"), ("contextual", "spelling", "g2"), ("contextual", "cooccurrence_context", "g4"), ("contextual", "masked", "g5"))
_ALL = " UNION ALL ".join(f"SELECT '{s}' AS system, '{g}' AS generator, item_id, rank, word, score FROM {t}" for s, g, t in _GENERATORS)
EVALUATION = f"""{_FULL},\n{_SAME},{_SHARE},{_COOC},{ranked('g1', 'pool', 'ASC', 30)},{ranked('g2', 'share', 'ASC', 30)},{cooc(False, name='g3', n=30)},{cooc(True, name='g4', n=30)},{masked('g5', 30)},
gens AS ({_ALL}),
base AS (SELECT DISTINCT item_id, word, 0 AS rank FROM gens),{_CANDS},{_DEP},{_FLAG_DEP},{_FLAG_PLL},\n{_FLAG_TRI}
SELECT g.item_id, g.system, g.generator, g.rank, g.word, g.score, bt.bad_trigram, bd.word IS NOT NULL AS bad_dependency, CASE WHEN g.system <> 'plain' THEN pc.pll END AS pll, CASE WHEN g.system <> 'plain' THEN {_BAD_PLL} END AS bad_pll
FROM gens g JOIN bt ON bt.item_id = g.item_id AND bt.word = g.word JOIN ctx c ON c.item_id = g.item_id LEFT JOIN bd ON bd.item_id = g.item_id AND bd.word = g.word LEFT JOIN pc ON pc.item_id = g.item_id AND pc.word = g.word LEFT JOIN pt ON pt.item_id = g.item_id"""

SQL = {
    "evaluation_counted": f"WITH {EVALUATION}",
    "sentence_split": f"WITH {SENT} SELECT key AS doc_id, sent_no, sent, len FROM sent",
    "sentence_length_stats": f"WITH {SENT} SELECT count(*) AS n, round(avg(len), 6) AS mean, CAST(median(len) AS DOUBLE) AS median, min(len) AS min, max(len) AS max, round(stddev_pop(len), 6) AS std FROM sent",
    "length_histogram": f"WITH {SENT}, e AS (SELECT min(len) AS lo, max(len) AS hi FROM sent) SELECT CAST(least(floor((len - lo) * 50.0 / (hi - lo)) + 1, 50) AS BIGINT) AS bin, count(*) AS n FROM sent, e GROUP BY 1",
    "long_sentences": f"WITH {SENT} SELECT key AS doc_id, sent_no, sent, len FROM sent WHERE len > 200 ORDER BY key, sent_no LIMIT 10",
    "reader_counters": f"WITH {SENT} SELECT (SELECT count(*) FROM documents) AS n_articles, count(DISTINCT key) AS n_with_sentences, count(*) AS n_sentences FROM sent",
    "char_stats": rf"""WITH c AS (SELECT doc_id, text, length(text) AS n_chars, len(regexp_extract_all(text, '{SCRIPT}')) AS n_script FROM documents)
SELECT doc_id, n_chars, CAST(len(list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda w: w <> '')) AS BIGINT) AS n_words, CAST(n_script AS BIGINT) AS n_script,
  CAST(n_chars - n_script - len(regexp_extract_all(text, '{BLANK}')) AS BIGINT) AS n_other, round(n_script / n_chars, 6) AS ratio, n_chars BETWEEN 8 AND 300 AS length_ok, n_script / n_chars >= 0.3 AS ratio_ok FROM c""",
    "word_freq": f"WITH {VOC} SELECT * FROM voc",
    "word_details": f"WITH {VOC_INFLECTED} {DETAILS}",
    "unknown_words": f"WITH {VOC_INFLECTED} SELECT u.key AS doc_id, u.sent_no, k, token AS surface, detail, concat(left(sent, 50), '...') AS context FROM (SELECT * FROM vt WHERE unknown ORDER BY key, sent_no, k LIMIT 1000) u JOIN sent ON sent.key = u.key AND sent.sent_no = u.sent_no",
    "vocabulary_sizes": f"WITH {VOC},{_CT} SELECT count(DISTINCT (lemma, pos)) AS n_words, count(DISTINCT lemma) AS n_lemmas, count(DISTINCT token) AS n_surfaces, (SELECT count(DISTINCT token) FROM ct) AS n_tokens FROM vt",
    "words_per_text": f"WITH {TOK} SELECT key AS doc_id, sf AS word, count(*) AS cnt FROM tok GROUP BY 1, 2",
    "wakati": f"WITH {TOK} SELECT s.key AS doc_id, s.sent_no, coalesce(string_agg(sf, ' ' ORDER BY i), '') AS words FROM sent s LEFT JOIN tok t ON s.key = t.key AND s.sent_no = t.sent_no GROUP BY 1, 2",
    "first_sentences": f"WITH {SENT} SELECT key AS doc_id, sent_no, sent, len FROM sent ORDER BY key, sent_no LIMIT 1000",
    "fill_placeholders": f"WITH {ITEMS} SELECT item_id, replace(concat(sentence, ' / ', sentence), '___', target) AS filled, replace(sentence, '___', '[MASK]') AS masked FROM items",
    "valid_tokens": "SELECT item_id, array_to_string(list_filter(string_split(text, ' '), lambda w: length(w) >= 4 AND trim(w) <> ''), ' ') AS words FROM benchmark",
    "article_files": f"WITH {SENT} SELECT CAST(4 AS BIGINT) AS n_files, CAST(2 AS BIGINT) AS n_broken, (SELECT count(*) FROM documents) AS n_articles, count(DISTINCT key) AS n_with_sentences, count(*) AS n_sentences FROM sent",
    "token_lines": f"WITH {COR} SELECT token AS word, count(*) AS cnt FROM ct GROUP BY token",
    "csv_items": """SELECT concat('a "___", ', text) AS sentence, 't' AS target, concat(text, chr(10), ',b') AS english_sentence FROM benchmark""",
    "packed_words": f"WITH {VOC_INFLECTED} {DETAILS} ORDER BY frequency DESC, lemma, pos LIMIT 200",
    "packed_nations": "SELECT n_name AS name, concat(n_regionkey, '|x') AS rest, CAST(n_nationkey AS BIGINT) AS nationkey FROM nation",
    "literal_items": f"""WITH lit AS (SELECT * FROM (VALUES {_literal()}) t(item_id, sentence, target)),
{tokens('ltok', "(SELECT item_id AS key, 1 AS side, left(sentence, instr(sentence, '___') - 1) AS sent FROM lit UNION ALL SELECT item_id, 2, substr(sentence, instr(sentence, '___') + 3) FROM lit UNION ALL SELECT item_id, 3, replace(sentence, '___', target) FROM lit)", 'key, side')},
{folded('lc', 'ltok', 'key, side')},{folded('lv', 'ltok', 'key, side', loose=False)},
ln AS (SELECT key, count(*) AS n FROM lv WHERE side = 1 GROUP BY key)
SELECT i.item_id, i.target, coalesce(a.lemma, s.lemma) AS lemma, coalesce(a.pos, s.pos) AS pos, coalesce((SELECT last(token ORDER BY k) FROM lc WHERE key = i.item_id AND side = 1), 'BOS') AS prev_word,
  coalesce((SELECT first(token ORDER BY k) FROM lc WHERE key = i.item_id AND side = 2), 'EOS') AS next_word FROM lit i LEFT JOIN ln ON ln.key = i.item_id
  LEFT JOIN lv a ON a.key = i.item_id AND a.side = 3 AND a.k = coalesce(ln.n, 0) AND contains(a.token, i.target)
  LEFT JOIN (SELECT key, token, first(lemma ORDER BY k) AS lemma, first(pos ORDER BY k) AS pos FROM lv WHERE side = 3 GROUP BY key, token) s ON s.key = i.item_id AND s.token = i.target""",
    "word_freq_merge": f"""WITH {VOC},{sentences('s2', "(SELECT conv_id * 100000 + turn AS id, text FROM conversations)", 'id')},{tokens('t2', 's2')},{folded('v2', 't2', loose=False)}
SELECT lemma, pos, CAST(count(*) AS BIGINT) AS frequency FROM (SELECT lemma, pos FROM vt UNION ALL SELECT lemma, pos FROM v2) GROUP BY lemma, pos""",
    "words_repeated": f"WITH {VOC} SELECT * FROM voc WHERE frequency > 1",
    "top_words": f"WITH {VOC} SELECT * FROM voc ORDER BY frequency DESC, lemma, pos LIMIT 20",
    "pos_distribution": f"WITH {VOC} SELECT pos, CAST(sum(frequency) AS BIGINT) AS frequency FROM voc GROUP BY pos",
    "unknown_rate": f"WITH {VOC_INFLECTED} SELECT round(100.0 * count(*) FILTER (unknown) / count(*), 6) AS unknown_percent FROM vt",
    "lookahead_tokens": f"WITH {COR} SELECT key AS doc_id, sent_no, k, token FROM ct",
    "vocab_tokens": f"WITH {VOC} SELECT key AS doc_id, sent_no, k, lemma, pos, token AS surface FROM vt",
    "pos_prefix_extract": f"WITH {TOK} SELECT s.key AS doc_id, s.sent_no, coalesce(string_agg(sf, ' ' ORDER BY i) FILTER (p LIKE 'VE%'), '') AS verbs FROM sent s LEFT JOIN tok t ON s.key = t.key AND s.sent_no = t.sent_no GROUP BY 1, 2",
    "clean_lemma": f"""WITH l AS (SELECT p_partkey, concat_ws('-', p_name, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN replace(p_type, ' ', '') ELSE '' END) AS lemma FROM part)
SELECT p_partkey, lemma, {clean('lemma')} AS cleaned FROM l""",
    "cooc_totals": f"WITH {PAIRS} SELECT count(*) AS n_unique, CAST(sum(cnt) AS BIGINT) AS n_instances, count(*) FILTER (cnt >= 5) AS n_frequent FROM allpairs",
    "cooc_pruned": f"WITH {PAIRS} SELECT * FROM pairs",
    "cooc_index": f"WITH {PAIRS} SELECT w1 AS word, w2 AS other, cnt FROM pairs UNION ALL SELECT w2, w1, cnt FROM pairs",
    "trigram_totals": f"WITH {TRI} SELECT count(*) AS n_unique, CAST(sum(cnt) AS BIGINT) AS n_instances, count(*) FILTER (cnt >= 2) AS n_frequent FROM alltri",
    "trigram_pruned": f"WITH {TRI} SELECT * FROM tri",
    "dep_pruned": f"WITH {DEP} SELECT * FROM dep",
    "dep_index": f"WITH {DEP} SELECT head AS word, * FROM dep UNION ALL SELECT child AS word, * FROM dep",
    "char_index": f"WITH {VOC} SELECT DISTINCT unnest(string_split(lemma, '')) AS ch, lemma, pos FROM voc",
    "top_pairs": f"WITH {PAIRS} SELECT * FROM pairs ORDER BY cnt DESC, w1, w2 LIMIT 20",
    "bottom_pairs": f"WITH {PAIRS} SELECT * FROM pairs ORDER BY cnt, w1, w2 LIMIT 20",
    "pairs_with_word": f"WITH {PAIRS} SELECT CASE WHEN w1 = 'of' THEN w2 ELSE w1 END AS other, cnt FROM pairs WHERE 'of' IN (w1, w2) ORDER BY cnt DESC, other LIMIT 50",
    "trigrams_with_word": f"WITH {TRI} SELECT * FROM tri WHERE 'of' IN (w1, w2, w3) ORDER BY {drawn('w1', 'w2', 'w3')} LIMIT 50",
    "sample_trigrams": f"WITH {TRI} SELECT * FROM tri ORDER BY {drawn('w1', 'w2', 'w3')} LIMIT 20",
    "sample_relations": f"""WITH {DEP}, byw AS (SELECT head AS word, * FROM dep UNION ALL SELECT child AS word, * FROM dep), w AS (SELECT DISTINCT word FROM byw), d AS (SELECT unnest(range(1, 21)) AS draw),
x AS (SELECT draw, word FROM w, d QUALIFY row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', 1, draw, word)), word) = 1)
SELECT draw, x.word, dep, head, child FROM x JOIN byw USING (word) QUALIFY row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', 1, draw, dep, head, child)), dep, head, child) = 1""",
    "relations_with_word": f"WITH {DEP} SELECT * FROM dep WHERE 'inin' IN (head, child) ORDER BY {drawn('dep', 'head', 'child')} LIMIT 50",
    "cloze_items": f"WITH {ITEMS} SELECT * FROM items",
    "target_in_context": f"WITH {LOCATED} SELECT item_id, target, lemma, pos FROM loc",
    "trigram_context": f"WITH {LOCATED} SELECT item_id, prev_word, next_word FROM loc",
    "gen_baseline": f"WITH {BASE} SELECT * FROM base",
    "gen_spelling": f"WITH {VOC},{LOCATED},\n{_SAME},\nshare AS (SELECT * FROM pool WHERE list_has_any({_LETTERS % 'lemma'}, {_LETTERS % 'word'})),{ranked('res', 'share', 'ASC')} SELECT * FROM res",
    "gen_similarity": f"WITH {NEAR} SELECT item_id, {_TOPN}, word, score FROM near QUALIFY rank <= 20",
    "gen_similarity_band": f"""WITH {NEAR}, big AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, word) <= 200)
SELECT item_id, {_TOPN}, word, score FROM big WHERE score BETWEEN CASE context WHEN 'OPEN' THEN 0.1 WHEN 'CLOSED' THEN 0.2 ELSE 0.1 END AND CASE context WHEN 'OPEN' THEN 0.3 WHEN 'CLOSED' THEN 0.4 ELSE 0.35 END QUALIFY rank <= 20""",
    "gen_cooc_pmi": f"WITH {_FULL},{_COOC},{cooc(False)} SELECT * FROM res",
    "gen_cooc_pmi_k": f"WITH {_FULL},{_COOC},{cooc(True)} SELECT * FROM res",
    "gen_cooc_lemma": f"WITH {_INFLECTED},{_COOC},{cooc(False, True)} SELECT * FROM res",
    "gen_contextual": f"""WITH {MASK}, top AS (SELECT item_id, token AS word, round(prob, 6) AS score FROM probs QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(prob, 6) DESC, token) <= 200),
f AS (SELECT top.* FROM top JOIN ctx c USING (item_id) WHERE word <> c.target AND NOT starts_with(word, '##') AND word <> '[UNK]'
  AND score BETWEEN 0.005 AND CASE c.context WHEN 'OPEN' THEN 0.5 WHEN 'CLOSED' THEN 0.9 ELSE 0.95 END)
SELECT item_id, {_TOPN}, word, score FROM f QUALIFY rank <= 20""",
    "context_class": f"WITH {MASK} SELECT item_id, prev_word, next_word, entropy, context FROM ctx",
    "pll_scores": f"WITH {TRI},{_ITEM_TOK},\nws AS (SELECT key AS item_id, sent_no, i, sf AS w FROM itok),{_LP},{pll('res', 'ws', 'item_id, sent_no')} SELECT * FROM res",
    "filter_trigram": f"WITH {SCREEN} SELECT item_id, rank, word, bad_trigram FROM bt",
    "filter_dependency": f"WITH {SCREEN} SELECT b.item_id, b.rank, b.word, bd.word IS NOT NULL AS bad_dependency FROM base b LEFT JOIN bd ON bd.item_id = b.item_id AND bd.word = b.word",
    "filter_pll": f"WITH {SCREEN} SELECT b.item_id, b.rank, b.word, pc.pll, {_BAD_PLL} AS bad_pll FROM base b JOIN ctx c ON c.item_id = b.item_id LEFT JOIN pc ON pc.item_id = b.item_id AND pc.word = b.word LEFT JOIN pt ON pt.item_id = b.item_id",
    "final_candidates": f"""WITH {SCREEN} SELECT b.item_id, b.rank, b.word FROM bt b JOIN ctx c ON c.item_id = b.item_id LEFT JOIN bd ON bd.item_id = b.item_id AND bd.word = b.word
  LEFT JOIN pc ON pc.item_id = b.item_id AND pc.word = b.word LEFT JOIN pt ON pt.item_id = b.item_id WHERE NOT b.bad_trigram AND bd.word IS NULL AND NOT ({_BAD_PLL})""",
}
