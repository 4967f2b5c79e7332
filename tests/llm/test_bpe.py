"""Byte-level BPE against the tiktoken library."""

import base64
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tessella.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_equals_the_library(docs, no_docs, monkeypatch):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    texts = [r.text for r in docs.collect()]
    for words in (1 << 17, 3):  # with and without words from the frequent ones
        monkeypatch.setattr(bpe, "WORDS", words)
        rows = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
        assert sorted(tuple(r.ids) for r in rows) == sorted(tuple(library.encode_ordinary(t or "")) for t in texts)
        assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for t in texts)
    assert bpe.decode(bpe.encode(no_docs, PATH, PATTERN), PATH, PATTERN).count() == 0


def test_white_space_and_marks(spark):
    texts = ["a  b  c　　 d\r\n\r\n x", "​\u0085'LL 'll 12²Ⅴ", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 8, "  ", "\n\n\n a"]
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: list(r.ids) for r in bpe.encode(df, PATH, PATTERN).collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_ordered_ranks_are_folded_in_a_turn_a_merge(spark):
    tokenizer = bpe.Tokenizer(spark, PATH, PATTERN)
    assert tokenizer.ordered
    r = random.Random(4)
    parts = ["er", "tion", "ä", "é", "sch", "aa", "a", "zq", " ", "0", "\U0001f600", "ó", "xx"]
    words = ["a", "é", "aaa", "x" * 200] + ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(500)]
    library = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=tokenizer.ranks, special_tokens={})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", bpe.folded_ordered(F.col("w"), tokenizer.bytes, tokenizer.rank_map()).alias("ids")).collect()
    assert {x.w: x.ids for x in got} == {w: library.encode_ordinary(w) for w in words}


def test_ranks_that_are_not_ordered_keep_the_leftmost_pair(spark, tmp_path):
    # "abc" comes before its parts, and is two pieces in two ways
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate([b"abc", b"bc", b"ab", b"cab", b"abca", b"bca"])}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % v for t, v in ranks.items()))
    assert not bpe.Tokenizer(spark, str(path), PATTERN).ordered
    r = random.Random(6)
    texts = ["".join(r.choice("abcd ") for _ in range(40)) for _ in range(60)]
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: list(x.ids) for x in bpe.encode(df, str(path), PATTERN).collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}
