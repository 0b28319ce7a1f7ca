import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from lacuna.llm import tokenbin
from lacuna.llm.common import text_bytes
from lacuna.llm.queries import op6_token_output

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_tokenizer(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in op6_token_output(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute(rows)


ODD = ["", None, " \n\t", "it's we'll 'S x'y 'sa", "a<|endoftext|>b <|EndOfText|> <| c", "Ünḯçødé é .́x ≠ İSTANBUL ΣΑΣ Σ", "3d x2.5!!a###b", "\x00 a\x00b", " x　y z", "A\x1cB\x85C", "ﬁ½²٣", "x" * 5000]


def test_units_never_change_ids():
    t = Tokenizer.from_file(PATH)
    ids, count = tokenbin.Encoder(PATH).encode(*text_bytes(pa.array(ODD)))
    want = [t.encode(x or "", add_special_tokens=False).ids for x in ODD]
    assert count.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_forgetting_and_random_texts(monkeypatch):
    monkeypatch.setattr(tokenbin, "REMEMBERED", 30)
    rng = np.random.default_rng(1)
    chars = list("abzAZ '.,!<|>09-\n\t́éßñ 日'")
    t, e = Tokenizer.from_file(PATH), tokenbin.Encoder(PATH)
    for _ in range(60):
        texts = ["".join(rng.choice(chars, rng.integers(0, 60))) for _ in range(7)]
        ids, count = e.encode(*text_bytes(pa.array(texts)))
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert [i for w in want for i in w] == ids.tolist(), texts


def test_pack_round_trip():
    x = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7, 9], np.uint32)
    for n in range(len(x) + 1):
        for lengths in ([n], [n // 2, 0, n - n // 2], [1] * n):
            lengths = np.array(lengths, np.int64)
            control, data, _, _ = tokenbin.pack(x[:n], lengths)
            assert tokenbin.unpack(control, data, lengths).tolist() == x[:n].tolist()


def test_file_keeps_order_ties_and_nulls(spark, tmp_path, monkeypatch):
    rows = [(i * 37 % 50, t) for i, t in enumerate(ODD * 5)] + [(3, "same"), (3, "same"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", df_lit())
    tokenbin.write_tokens(df, f"file://{tmp_path}/t", PATH, shard_ids=500)
    got = tokenbin.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, *sorted(d for d, _ in rows if d is not None)]
    assert [r.start for r in got] == np.cumsum([0] + [len(r.ids) for r in got])[:-1].tolist()
    t = Tokenizer.from_file(PATH)
    assert sorted((r.doc_id or -1, r.ids) for r in got) == sorted((d or -1, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for d, x in rows)
    tokenbin.write_tokens(df.limit(0), f"file://{tmp_path}/e", PATH)
    assert tokenbin.read_tokens(spark, f"file://{tmp_path}/e").collect() == []


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_long_texts_are_tokenized_in_blocks(monkeypatch):
    import lacuna.llm.common as C

    texts = [" ".join(f"Word{i} it's" for i in range(200)), "x" * 900 + " <|endoftext|> y", "short"]
    t = Tokenizer.from_file(PATH)
    monkeypatch.setattr(C, "SLICE_BYTES", 100)
    monkeypatch.setattr(C, "blocks", lambda raw, table, f=C.blocks: f(raw, table, 100))
    batches = [pa.record_batch({"doc_id": pa.array([i]), "text": pa.array([x])}) for i, x in enumerate(texts)]
    for row, x in zip([r for b in tokenbin._tokenize(iter(batches), PATH, 1) for r in b.to_pylist()], texts, strict=True):
        want = [*t.encode(x, add_special_tokens=False).ids, 1]
        assert tokenbin._planes(row["ids"]).tolist() == want and row["lengths"] == [len(want)]
