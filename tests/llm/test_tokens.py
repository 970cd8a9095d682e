import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.llm.queries import vocabulary
from geoloom.llm import tokens
from geoloom.llm.tokens import BpeEncoder, contract_queued, encode, encoder

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def peer():
    t = tokenizers.Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return t


def ids(texts):
    return encoder(vocabulary()).encode(pa.array(texts, pa.string())).to_pylist()


SPECIAL = [
    "", " ", "  ", "\n", " \n x", "I'll don't we've 'S it's", "''s 's", "x'", "a b", "Αθήνα café 漢字",
    "<|endoftext|> and more", "123 4567 ½²", "é​\U0001f600!!!", "tab\tand  two", "  lead", "trail  ", "a'reb 'llc 'd", "\x00\x1c\x85",
    "x" * 3000, "-" * 500, "'", " 's", "\n's",
]


def test_special_texts(peer):
    assert ids(SPECIAL) == [peer.encode(t, add_special_tokens=False).ids for t in SPECIAL]


signs = st.sampled_from(list(" \t\n'stmdrevlaL9½.!-é漢́ \xa0\U0001f600") + ["'ll", "'re", " '", "  "])


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(signs, max_size=30).map("".join), max_size=6))
def test_texts_as_the_library_has_them(texts):
    t = tokenizers.Tokenizer.from_file(vocabulary()) if not hasattr(test_texts_as_the_library_has_them, "t") else test_texts_as_the_library_has_them.t
    t.encode_special_tokens = True
    test_texts_as_the_library_has_them.t = t
    got = ids(texts)
    assert got == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [encoder(vocabulary()).decode(g) for g in got] == texts


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_rank_files(name):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers

    path = vocabulary(name)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*SPECIAL, "Die Sitzung ist eröffnet. Η συνεδρίαση αρχίζει, y así se aprobó; l'été déjà."]
    got = encoder(path).encode(pa.array(texts)).to_pylist()
    assert got == [peer.encode_ordinary(t) for t in texts]
    assert [encoder(path).decode(g) for g in got] == texts


def test_table(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "Hello  world", 5), (4, "word " * 30_000, 5), (3, "Hello  world", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    got = sorted(encode(df, ["doc_id"], F.col("text"), vocabulary()).collect())
    assert got[0].ids == [] and got[1].ids == [] and got[2].ids == got[3].ids == [15496, 220, 995] and len(got[4].ids) == 30_001
    counts = encode(df, ["doc_id"], F.col("text"), vocabulary(), "n", only_counts=True)
    assert sorted(map(tuple, counts.collect())) == [(1, 0), (2, 0), (3, 3), (3, 3), (4, 30_001)]
    assert encode(df.limit(0), ["doc_id"], F.col("text"), vocabulary()).count() == 0
    with pytest.raises(ValueError):
        encode(df, ["tokens"], F.col("text"), vocabulary(), "tokens")


def test_pieces_and_forgetting(monkeypatch):
    texts = [f"some text number {i} of many" for i in range(200)]
    whole = ids(texts)
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 100)
    monkeypatch.setattr(tokens, "KEPT_WORDS", 20)
    monkeypatch.setattr(tokens, "QUERY_BYTES", 30)
    encoder(vocabulary()).forget()
    assert ids(texts) == whole


def letters(n, signs):
    return "".join(np.random.default_rng(n).choice(list(signs), n))


LONG = [letters(n, signs) for n in (900, 1024, 1100, 5000) for signs in ("abcdefghijklmnopqrstuvwxyz", "acgt", "a", "aab", "αβγ", "=-")]


def test_long_words(peer):
    assert ids(LONG) == [peer.encode(t, add_special_tokens=False).ids for t in LONG]


def test_both_ways_of_contraction_agree(monkeypatch):
    texts = [*SPECIAL, *LONG[:6]]
    for name in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"):
        queried = BpeEncoder(vocabulary(name)).encode(pa.array(texts)).to_pylist()
        with monkeypatch.context() as m:
            m.setattr(tokens, "LONG_WORD", 0)
            assert BpeEncoder(vocabulary(name)).encode(pa.array(texts)).to_pylist() == queried


def test_merges_out_of_order():
    """A pair of lower rank that takes up the token just made goes before the next pair of that token."""
    db = duckdb.connect()
    merges = {(1, 2): (5, 3), (3, 1): (2, 4), (2, 1): (7, 6)}
    rows = [(a, b, rank, made, made == 3) for (a, b), (rank, made) in merges.items()]
    db.execute("CREATE TABLE merges (a INT, b INT, rank INT, made INT, alone BOOL)")
    db.executemany("INSERT INTO merges VALUES (?, ?, ?, ?, ?)", rows)
    for word in ([1, 2, 1, 2], [1, 2, 1, 2, 1, 2], [2, 1, 2, 1], [1, 1, 2, 2, 1]):
        start = pa.table({"word": [0] * len(word), "pos": range(len(word)), "tok": word})
        db.register("start", start)
        assert db.sql(tokens._CONTRACT).fetchall() == [(0, contract_queued(word, merges))]
    assert contract_queued([1, 2, 1, 2], merges) == [4, 2]


def test_a_very_long_word():
    word = letters(100_000, "abcdefghijklmnopqrstuvwxyz")
    began = time.process_time()
    (made,) = ids([word])
    assert time.process_time() - began < 10 and encoder(vocabulary()).decode(made) == word
