import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leadloom.llm import bpe_index, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = [*"aabcdeéÉèßñΣσς  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 '’sdtmll12²½Ⅷ٣漢字🙂İıǅ_-!?<|>.,€Жж한각ﬁÅ", "<|endoftext|>", "<|startoftext|>", "'ll", "'re", "aaaa", "é"]


def strange(seed, n=400):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return made + ["", " ", "a" * 5000, "ab" * 3000, "\n" * 50, "the " * 3000]


def test_counts_match_the_library():
    count, library = token_counts.counter(BYTES).count, Tokenizer.from_file(BYTES)
    for text in strange(1, 3000):
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_encoding_matches_the_library():
    library, texts = Tokenizer.from_file(WORDS), strange(2, 3000)
    for text, (ids, decoded) in zip(texts, bpe_index.WordBpe(WORDS).encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoded == library.decode(want, skip_special_tokens=False), text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    one, two = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    assert token_counts.counter(BYTES).count(text) == len(one.encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(bpe_index.encoder(WORDS).encode([text])[0][0], "<u4").tolist() == two.encode(text, add_special_tokens=False).ids


def test_memory_of_words_is_bounded(monkeypatch):
    texts = strange(3, 200)
    want = bpe_index.WordBpe(WORDS).encode(texts)
    monkeypatch.setattr(bpe_index, "REMEMBERED", 20)
    small = bpe_index.WordBpe(WORDS)
    assert [pair for i in range(0, len(texts), 7) for pair in small.encode(texts[i:i + 7])] == want


def test_rows(spark):
    long = "word and more, " * 40_000
    rows = [(1, "The cat."), (2, None), (3, ""), (4, "a<|endoftext|>b"), (None, "The cat."), (1, "The cat."), (5, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as ids")
    library = Tokenizer.from_file(BYTES)
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = sorted((tuple(r) for r in token_counts.token_counts(df, BYTES).collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), size(t), size(t) > 1024) for i, t in rows), key=repr)
    words = Tokenizer.from_file(WORDS)
    want = []
    for i, t in rows:
        ids = words.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(words.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((tuple(r) for r in bpe_index.encode_decode(df, WORDS, digests=True).collect()), key=repr) == sorted(want, key=repr)
    plain = {r.doc_id: (r.ids, r.decoded) for r in bpe_index.encode_decode(df, WORDS).filter("doc_id = 4").collect()}
    ids = words.encode("a<|endoftext|>b", add_special_tokens=False).ids
    assert plain == {4: (ids, words.decode(ids, skip_special_tokens=False))}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(none, BYTES).collect() == bpe_index.encode_decode(none, WORDS).collect() == []


def test_every_code_point():
    """Counts and ids of each code point between letters, over all planes."""
    one, two = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    mine, encoder = token_counts.counter(BYTES), bpe_index.encoder(WORDS)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x33500 or c % 97 == 0)]
    for i in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}b" for c in points[i: i + 20_000]]
        want = [len(e.ids) for e in one.encode_batch(texts, add_special_tokens=False)]
        assert [c for c, t, n in zip(points[i:], texts, want) if mine.count(t) != n] == []
        ids = [np.array(e.ids, "<u4").tobytes() for e in two.encode_batch(texts, add_special_tokens=False)]
        assert [c for c, (own, _), x in zip(points[i:], encoder.encode(texts), ids) if own != x] == []
