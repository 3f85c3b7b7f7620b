"""Byte-level BPE against the tiktoken library, and back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from dashloom.llm import byte_bpe
from dashloom.llm.queries import op11_byte_bpe
from dashloom.llm.registry import table
from pyspark.sql import functions as F

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
R = random.Random(5)
TEXTS = [None, "", " ", "\n\n \t", "Don't stop: it's 3²½!", "end ", "x" * 30_000, " " * 5000 + "a", "ab" * 2000, "日本語" * 500,
         "<|endoftext|> as text", "é‍🙂\U0010ffff\x00\x1c\x85\xa0"]
TEXTS += ["".join(R.choice("abÉéß 'st.,-\n19ªµ²日🙂\t") for _ in range(R.randrange(80))) for _ in range(300)]
TEXTS += ["".join(chr(R.randrange(0x20, 0xD800)) for _ in range(200)) for _ in range(20)]
TEXTS += ["a\u0cdcb 1\u0378 \U0001e6c0x\U00011de0", "\u0558\u0558 ab"]  # letters to a later Unicode only


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(FILE), special_tokens={})


def test_query_against_library(spark, sf, library):
    got = {r["doc_id"]: r for r in op11_byte_bpe(spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc, text in docs:
        ids = library.encode_ordinary(text or "")
        row = got[doc]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_odd_texts(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "clash"), (0, None, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("decoded", F.lit(1))
    coded = byte_bpe.decode(byte_bpe.encode(docs, FILE, public_tokenizers.PATTERN), FILE)
    got = coded.collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, text, _ in rows:
        assert by_id[i]["ids"] == library.encode_ordinary(text or "")
        assert bytes(by_id[i]["decoded"]) == (text or "").encode()


def test_long_texts_in_blocks(library, monkeypatch):
    own = byte_bpe.Encoder(FILE, public_tokenizers.PATTERN)
    text = "".join(R.choice(["word", " other", "\n\n", "  ", "123", "é", "日本", "x" * 90, " unheard-of"]) for _ in range(4000))
    whole = own.encode([text, None, "", text[:50]])
    assert np.frombuffer(whole[0], np.int32).tolist() == library.encode_ordinary(text) and whole[1] == whole[2] == b""
    for name, value in (("LONG", 100), ("BLOCK", 7), ("REMEMBERED", 3), ("TREES", 5)):
        monkeypatch.setattr(byte_bpe, name, value)
    own.known.clear()
    assert own.encode([text, None, "", text[:50]]) == whole


def test_merge_is_the_simple_one():
    """The tree takes the leftmost pair of least rank, as a search of all pairs does."""
    ranks = {bytes([b]): b for b in range(256)}
    for i in range(400):
        ranks.setdefault(bytes(R.choice(b"abc") for _ in range(R.randrange(2, 6))), 256 + i)
    want = {}
    for _ in range(500):
        piece = bytes(R.choice(b"abc") for _ in range(R.randrange(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want[piece] = [ranks[p] for p in parts]
        assert byte_bpe.merge(ranks, piece) == want[piece]
    got = byte_bpe.Forest(ranks).merged(list(want))
    assert [np.frombuffer(g, np.int32).tolist() for g in got] == list(want.values())


def test_ids_that_cannot_be_decoded(spark):
    rows = [(1, [40, 50256], "x"), (2, [-1], "x"), (3, None, "x"), (4, [], "x"), (5, [40, None], "x"), (6, [40], "x")]
    got = byte_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<long>, decoded string"), FILE)
    found = {r["doc_id"]: r["decoded"] for r in got.collect()}
    assert [found[i] for i in (1, 2, 3, 5)] == [None] * 4 and bytes(found[4]) == b"" and len(found[6]) > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(docs, FILE, public_tokenizers.PATTERN), FILE).count() == 0
