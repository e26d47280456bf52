import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from texspark.llm import byte_bpe

RANKS = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
PLAIN = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE = byte_bpe.ByteBPE(RANKS, P.PATTERN)
ALPHABET = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "\r\n", ".", ",,", "'s", "'", "1", "23", "é", "ß", "中文", "́", " ", "\xa0", "\x1c", "\x85", "🙂", "՘", "࢏", "\U000323b0", "͸", "<|endoftext|>", "\x00", "Ǆ", "²", "؀"]


def ids_of(text):
    return np.frombuffer(BPE.encode([text])[0], dtype="<u4").tolist()


def test_random_texts_have_the_ids_of_the_library():
    rng = random.Random(5)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(24))) for _ in range(4000)]
    for some in (texts, *([t] for t in texts[:100])):
        for text, ids in zip(some, BPE.encode(some), strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == PLAIN.encode_ordinary(text), repr(text)
            assert BPE.decode(ids) == text.encode()


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 3)
    for text in ("a bc def ghij", "a bc xyz", "", "q"):
        assert ids_of(text) == PLAIN.encode_ordinary(text)


@pytest.mark.parametrize("n", [3, 60, 100, 1000, 12_000])
def test_long_pre_tokens_have_the_ids_of_the_library(n):
    rng = random.Random(n)
    for letters in ("a", "ab", "thein", "abcdefghijklmnopqrstuvwxyz", "é中ab", "=", "0123456789"):
        text = "".join(rng.choices(letters, k=n))
        assert ids_of(text) == PLAIN.encode_ordinary(text)


def test_each_character_beside_a_letter_a_digit_and_white_space():
    texts = ["".join(f"{chr(c)}a {chr(c)}1 {chr(c)}!\t{chr(c)}\n" for c in range(k, k + 256) if not 0xD800 <= c < 0xE000) for k in [*range(0, 0x3200, 256), *range(0xA000, 0x18000, 256), *range(0x1D000, 0x20000, 256), 0x2EB00, 0x32300, 0x33400]]
    assert [ids_of(t) for t in texts] == PLAIN.encode_ordinary_batch(texts)


def test_a_pre_token_of_a_megabyte_takes_seconds():
    text = "".join(random.Random(1).choices("abcdefgh", k=1 << 20))
    began = time.time()
    ids = ids_of(text)
    assert time.time() - began < 60
    assert BPE.decode(np.array(ids, dtype="<u4").tobytes()) == text.encode() and ids == PLAIN._encode_single_piece(text)


def test_the_queue_gives_the_least_rank_and_its_places_in_order():
    queue = byte_bpe.RankQueue(300_000)
    queue.fill(np.array([5, -1, 299_999, 5, 70_000]))
    for rank, place in ((70_000, 1), (5, 2), (64, 9), (70_000, 0), (5, 0)):
        queue.push(rank, place)
    got = []
    while (entry := queue.pop()) is not None:
        got.append((entry[0], entry[1].tolist()))
    assert got == [(5, [0, 2, 3]), (64, [9]), (70_000, [0, 1, 4]), (299_999, [2])]
    assert not any(map(any, queue.levels)) and not queue.buckets


def test_a_vocabulary_whose_later_pairs_have_lower_ranks():
    ranks = {bytes([b]): 10 + b for b in range(256)} | {b"ab": 9, b"bc": 8, b"abc": 3, b"cab": 2, b"aa": 7, b"aaa": 1}
    own, plain = byte_bpe.ByteBPE(ranks, r"\w+|\W"), tiktoken.Encoding("own", pat_str=r"\w+|\W", mergeable_ranks=ranks, special_tokens={})
    assert own.unsafe
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choices("abcd", k=rng.randrange(30)))
        assert np.frombuffer(own.encode([text])[0], dtype="<u4").tolist() == plain.encode_ordinary(text)


def test_rows_keep_their_columns_and_nulls_are_empty(spark):
    schema = "doc_id long, text string, ranks string, n_tokens int"
    rows = [(1, "Hello  world \n again", "x", 5), (2, None, None, None), (3, "", "y", 1), (None, "é <|endoftext|>", "z", 2), (1, "Hello  world \n again", "x", 5), (4, "ab" * 40_000, "x", 0)]
    encoded = byte_bpe.encode(spark.createDataFrame(rows, schema), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert encoded.columns == ["doc_id", "ranks", "n_tokens", "ids"]
    got = sorted(((r.doc_id or 0, r.ranks, r.n_tokens, np.frombuffer(bytes(r.ids), dtype="<u4").tolist()) for r in encoded.collect()), key=str)
    assert got == sorted(((d or 0, a, b, PLAIN.encode_ordinary(t or "")) for d, t, a, b in rows), key=str)
    again = byte_bpe.decode(encoded, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert sorted(bytes(r.decoded) for r in again.collect()) == sorted((t or "").encode() for _, t, *_ in rows)
    empty = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame([], schema), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert empty.collect() == [] and empty.columns == ["doc_id", "ranks", "n_tokens", "decoded"]


def test_the_query_has_the_digests_of_the_library(spark, tmp_path):
    texts = ["Some words.", None, "", "é\n\n x", "Some words."]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in byte_bpe.op12_byte_bpe(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = np.array(PLAIN.encode_ordinary(t or ""), dtype="<u4")
        assert got[i] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
