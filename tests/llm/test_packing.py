import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from texspark.llm import packing

DOCS = "doc_id long, text string, source string, ids string, lane int"
TEXTS = ["Hello  world \n again", None, "", "one two", "one two", "é ñ \t x\n\ny", "don't 'll  ", "word " * 4000, "a  b  c", "x\x1c y \x1c z", "hello <|endoftext|> x", "<|endoftext|><|endoftext|>  \n<|endoftext|>y", "<|endo ftext|>"]
ADDED = packing.added_tokens(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def pieces(spark):
    rows = [(i % 9, t, None if i % 3 == 0 else f"s{i % 3}", "clash", 1) for i, t in enumerate(TEXTS)]
    out = packing.pack(spark.createDataFrame(rows, DOCS), P.path("byte_bpe_50k.tiktoken"), packing.PATTERN, added=ADDED, window=64, quantum=8, lane_bytes=4000)
    return rows, out.collect()


def test_each_id_lies_in_one_piece_and_windows_have_no_gaps(pieces):
    rows, out = pieces
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for doc, text, *_ in rows:
        want[doc].append(np.array([*tk.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.doc_id, r.doc_tokens, r.start)):
        if r.start == 0:
            got[r.doc_id].append(b"")
        got[r.doc_id][-1] += bytes(r.ids)
        assert r.length * 4 == len(r.ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    windows = defaultdict(list)
    for r in out:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 64 and at & (at - 1) == 0


def test_ids_as_by_tokenizers():
    """Also for white space of any kind and length, words of any script and added tokens."""
    tk, rng = Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(3)
    encode = packing.Encoder(P.path("byte_bpe_50k.tiktoken"), packing.PATTERN, tuple(ADDED.items()))
    parts = [" ", "  ", "\n", "\t ", "\u2003", "\x1c", "\x85", "a", "Wörter", "don't", "'LL", "42", "½", "!?", "中文", "\U0001f600", "<|endoftext|>", "e\u0301", "\xa0"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(600)]
    texts += [x + blank * n + y for blank in (" ", "\n", " \t") for n in (1023, 1024, 3000) for x in ("", "a", "<|endoftext|>") for y in ("", "b", "<|endoftext|>", "\x1cb")]
    for text in texts:
        assert np.frombuffer(encode(text), encode.dtype).tolist() == tk.encode(text, add_special_tokens=False).ids, text[:80]
    assert len(encode(" " * 3_000_000 + "x")) > 0


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), P.path("byte_bpe_50k.tiktoken"), packing.PATTERN, added=ADDED).collect() == []


def test_digest_is_the_crc_of_the_ids(spark, pieces):
    row = packing.digest(spark.createDataFrame([(1, 0, 1, 1, 0, 0, b"\x01\0\0\0", "s")], "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, source string")).first()
    assert row.ids_crc32 == zlib.crc32(b"\x01\0\0\0")


def test_windows_hold_the_target_mix():
    lengths = [[100] * 60, [50] * 60, [10] * 100]
    total, shares = 10_000, [0.6, 0.3, 0.1]
    sums = defaultdict(lambda: [0, 0, 0])
    for q, _, _, n, w, _ in packing.deficit_round_robin(lengths, shares, [0, 0, 0], packing.rooms_of(total, 512), 32):
        sums[w][q] += n
    assert sum(map(sum, sums.values())) == total
    done = [0, 0, 0]
    for w in range(18):
        done = [a + b for a, b in zip(done, sums[w], strict=True)]
        assert all(abs(d - 512 * (w + 1) * s) <= 64 for d, s in zip(done, shares, strict=True))


def test_deficits_are_paid_over_lanes(spark):
    """A hot source with a text of many lanes: who is behind is served until it has its share of all windows so far."""
    window, quantum = 64, 16
    rows = [(i, f"word {i} " * (5 + i % 40), "cold" if i % 4 == 0 else "hot") for i in range(600)] + [(1000, "one more word " * 9000, "hot"), (1000, "one more word " * 9000, "hot")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), P.path("byte_bpe_50k.tiktoken"), packing.PATTERN, added=ADDED, window=window, quantum=quantum, lane_bytes=24_000, part_bytes=24_000).collect()
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for doc, text, _ in rows:
        want[doc].append([*tk.encode(text, add_special_tokens=False).ids, 0])
    pieces, left, total = defaultdict(list), defaultdict(int), defaultdict(int)
    for r in out:
        assert r.doc_tokens == len(want[r.doc_id][0])
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
        left[r.sequence_id >> 24, r.source] += r.length
        total[r.source] += r.length
    for doc, texts in want.items():  # both copies of a document cover each token once
        at = np.zeros(len(texts[0]), dtype=int)
        for start, ids in pieces[doc]:
            ids = np.frombuffer(ids, dtype="<u4")
            assert ids.tolist() == texts[0][start : start + len(ids)]
            at[start : start + len(ids)] += 1
        assert (at == len(texts)).all()
    assert len({r.sequence_id >> 24 for r in out if r.doc_id == 1000}) > 4
    shares = {s: n / sum(total.values()) for s, n in total.items()}
    done, far = defaultdict(int), 0
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        lane = r.sequence_id >> 24
        ahead = done[r.source] - shares[r.source] * sum(done.values())
        if ahead > 2 * window:
            far += 1
            assert not any(left[lane, s] for s in shares if s != r.source)
        done[r.source] += r.length
        left[lane, r.source] -= r.length
    assert far
