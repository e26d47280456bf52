import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from texspark.llm import alignment, packing

A, B = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
A.encode_special_tokens = True
PATHS = P.path("byte_bpe_50k.tiktoken"), packing.PATTERN, P.path("piece_bpe_32k.model")
# The public byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER = {chr(b): b for b in PLAIN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in PLAIN)}


def tokens(text):
    a = [(i, bytes(LETTER[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, B.id_to_piece(i)) for i in B.encode(text))]
    raw = b" " + text.encode()
    return (a, b) if text and b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def plain(texts):
    """Rows by the contract's words, text by text."""
    found = []
    for text in texts:
        a, b = tokens(text or "")
        ends = [np.cumsum([len(x) for _, x in t]).tolist() for t in (a, b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = [([i for (i, _), e in zip(a, ends[0], strict=True) if lo < e <= hi], [i for (i, _), e in zip(b, ends[1], strict=True) if lo < e <= hi]) for lo, hi in zip([0, *common], common, strict=False)]
        found.append((len(a), len(b), groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])))
    n = Counter(pair for *_, links in found for pair in links)
    best = defaultdict(int)
    for (x, _), k in n.items():
        best[x] = max(best[x], k)
    text_of = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return [(na, nb, len(g), sum(links.values()), sum(t for p, t in links.items() if n[p] == best[p[0]]), sum(t * n[p] for p, t in links.items()), hashlib.sha256(text_of(g).encode()).hexdigest() if na else "") for na, nb, g, links in found]


WORDS = ["the", "theing", "foo,bar", "é", "中文字", "\n", "\t x", " ", "  ", "   ", "1234", "<|endoftext|>", "<s>", "<0x41>", "🙂", "▁", "\x00", "\xa0", "　", "ﬁ", "é", "'ll", "####", "\r\n", "\x1c", "\x85", "unk", "<unk>"]


def texts_of(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_rows_are_those_of_the_plain_version(spark):
    texts = [None, "", "one two", "one two", "word " * 3000, "x" * 3000, "中" * 500, " lead", "trail ", *texts_of(3, 150)]
    rows = spark.createDataFrame([(i, t, "clash", "keys") for i, t in enumerate(texts)], "doc_id long, text string, pair string, keys string").repartition(5)
    out = alignment.align(rows, *PATHS)
    assert out.columns == ["doc_id", "pair", "keys", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else r.groups) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)


@pytest.mark.parametrize(("memo", "joined"), [(1 << 18, 1 << 18), (5, 20)])
def test_words_are_aligned_as_in_their_text(monkeypatch, memo, joined):
    monkeypatch.setattr(alignment, "MEMO", memo)
    monkeypatch.setattr(alignment, "JOINED", joined)
    both = alignment.Aligner(*PATHS)
    one = lambda pairs: np.ones(len(pairs), np.int64)
    texts = [*texts_of(9, 1200), "", None, *texts_of(10, 300)]
    pairs, rows = alignment.Pairs(both), alignment.Alignments(both, one, np.ones(1 << 16, np.int64))
    for k in range(0, len(texts), 50):
        some = texts[k : k + 50]
        for text, links, row in zip(some, pairs.of(some), rows.of(some), strict=True):
            ((*want, n_best, count_sum, _),) = plain([text])
            assert row[:4] == tuple(want) and row[5] == want[3], repr(text)
            assert (len(links) == 0) == (row[3] == 0)


def test_long_groups_count_each_pair(monkeypatch):
    both = alignment.Aligner(*PATHS)
    words = ["Ünïcödé", "中文字" * 5, "plain", "x" * 50]
    want = both.align(words, True)
    monkeypatch.setattr(alignment, "LINKS", 1)
    got = both.align(words, True)
    assert got[0].tolist() == want[0].tolist() and got[4] == want[4]
    links = lambda x: [Counter({p: sum(x[2][k] for k in range(lo, hi) if x[1][k] == p) for p in x[1][lo:hi].tolist()}) for lo, hi in zip([0, *x[3].tolist()], x[3].tolist(), strict=False)]
    assert links(got) == links(want)


def test_shards_hold_the_sums_in_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(20) << 32 | rng.randrange(50), rng.randrange(1, 9)) for _ in range(5000)] + [(7 << 32 | 7, 1)] * 3000
    found = alignment.shards(spark.createDataFrame(rows, "pair long, n long").repartition(6), f"file://{tmp_path}/x").collect()
    want = Counter()
    for k, n in rows:
        want[k] += n
    counts = alignment.Counts([tuple(r)[:5] for r in found])
    assert counts(np.array([*want, -5, 1 << 60])).tolist() == [*want.values(), 0, 0]
    assert sum(r.size for r in found) == len(want)
    best = Counter()
    for k, n in want.items():
        best[k >> 32] = max(best[k >> 32], n)
    assert {i: max(b for r in found for j, b in zip(r.ids, r.best, strict=True) if j == i) for i in best} == best


def test_an_empty_table_has_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []
