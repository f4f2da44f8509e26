"""The encoder against the public libraries."""

import random

import numpy as np
import pytest
from strandmill.llm import bpe, tokens

tokenizers = pytest.importorskip("tokenizers")
FILE = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def peer():
    found = tokenizers.Tokenizer.from_file(FILE)
    found.encode_special_tokens = True
    return lambda texts: [x.ids for x in found.encode_batch(texts, add_special_tokens=False)]


def test_hard_texts(peer):
    texts = ["", " ", "\n", "a", "  a", "a  ", " \n a", "'s", " 's", "x's's", "'sabc", "''s", "'", "it'll've", "a'", "'r", "'re", "<|endoftext|>", "\r\n\r\nx", "a​b", "é é", "1½Ⅳ２", " x", "  x", "𝒳𝒴 😀", "\x85\x1c"]
    assert bpe.encode_all(texts) == peer(texts)


def test_random_texts(peer):
    rng = random.Random(1)
    parts = [*"abst'  '\n\r\t'srevml d12.,-ä   é́​", "'s", "'re", "'ll", " '", "<|endoftext|>", "\r\n", "Rechtsprechung", " attendu que"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(5000)]
    assert bpe.encode_all(texts) == peer(texts)


def test_every_letter_class(peer):
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}  {chr(c)}" for c in range(1, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    assert bpe.encode_all(texts) == peer(texts)


def test_long_texts(peer):
    rng = random.Random(3)
    texts = ["a" * 30_000, "ab" * 9000 + "'s", " " * 9000 + "x", "é" * 3000, "".join(rng.choice("abcdefgh") for _ in range(9000)), "word " * 300_000]
    assert bpe.encode_all(texts) == peer(texts)


def test_speculation_is_verified():
    model = bpe.ByteBpe(bpe.read_vocabulary()[0])
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 15))).encode() for _ in range(3000)]
    flat, lengths = model.encode_words(words)
    ends = np.cumsum(lengths)
    assert [flat[b - n : b].tolist() for b, n in zip(ends, lengths)] == [model.merge(w) for w in words]
    assert 0 < model.repaired < model.speculated == 3000
    assert model.merge(b"abcdefgh" * 12) == model._merge_long(b"abcdefgh" * 12)
    assert all(model.merge(t) == [r] for t, r in list(model.ranks.items())[::37])


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"word{i} other{i}" for i in range(500)]
    want = bpe.encode_all(texts)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 50)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 300)
    model = bpe.ByteBpe(bpe.read_vocabulary()[0])
    values, offsets = model.encode_texts(texts)
    assert [values[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert model.count_texts(texts).tolist() == [len(x) for x in want]


def test_column(spark, peer):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "Hello", None), (None, "a", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = tokens.encode_column(df)
    assert found.columns == ["doc_id", "ids"]
    assert sorted(((r.doc_id, r.ids) for r in found.collect()), key=str) == sorted([(i, peer([t or ""])[0]) for i, t, _ in rows], key=str)
    assert tokens.encode_column(df.limit(0)).count() == 0
    counts = tokens.count_tokens(df, ["doc_id", "ids"])
    assert sorted(r.n_tokens for r in counts.collect()) == [0, 0, 1, 1, 2]


def test_long_words_leave_the_memo_alone():
    model = bpe.ByteBpe(bpe.read_vocabulary()[0])
    long = ["漢字かな" * 150, "x" * 500 + " short", "x" * 500, "base64" * 100]
    texts = [f"some words {i} {long[i % 4]} and {long[(i + 1) % 4]}" for i in range(40)]
    values, offsets = model.encode_texts(texts)
    words = len(model.memo)
    assert [values[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == bpe.encode_all(texts)
    assert words > 40 and not model.memo.long and all(len(w) <= bpe.MEMO_LENGTH for w in model.memo)
    again, _ = model.encode_texts(texts)
    assert (again == values).all() and len(model.memo) == words
    assert [model.decode(values[a:b].tolist()).decode() for a, b in zip(offsets, offsets[1:])] == texts
    assert model.count_texts(texts).tolist() == np.diff(offsets).tolist()
