import random

from hypothesis import given, settings
from hypothesis import strategies as st

from spanwright.llm.encoding import TOKENIZERS, Encoder, encode

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"


def truth(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_hard_texts():
    r = random.Random(2)
    x = ["a" * 3001, "ab" * 700, "".join(r.choice("abcdefgh") for _ in range(4000)), "<|endoftext|> hi", "日本語" * 200, " " * 999, "\n" * 500, "", None, "don't I'LL we've", "\x00\x01é​"]
    assert Encoder(PATH).encode(x) == truth(x)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_text(texts):
    assert Encoder(PATH).encode(texts) == truth(texts)


def test_frame(spark, sf):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", None), (3, "", None)], "doc_id long, text string, ids string")
    got = encode(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == [(1, [31373, 995]), (2, []), (3, []), (3, [])]
    assert encode(df.limit(0), "doc_id", "text").count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = {r["doc_id"]: r["ids"] for r in encode(docs, "doc_id", "text").collect()}
    assert [ids[k] for k in texts] == truth(list(texts.values()))
