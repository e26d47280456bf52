"""Byte-level BPE encoding and decoding with a rank queue of buckets under a hierarchical bitmap.

Bytes form a linked list. Each adjacent pair that the vocabulary can merge waits in the
bucket of its rank; a bitmap marks the buckets that hold places, and words of marks stand
above words of marks, so the next rank is found by one find-first-set for each level.
A bucket's places are merged together, from left to right; places whose pair has changed
meanwhile are stale and skipped. A pre-token of megabytes takes no longer a byte than a
short one, and the new words of some megabytes of text share one list and one queue.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texspark.llm.common import extended, table, text_slices

#: Bytes of text whose words are encoded together.
TOGETHER = 16 << 20
#: A worker remembers the ids of chunks of up to SHORT characters; with more than MEMO of them it keeps those in use.
MEMO, SHORT = 1 << 19, 64
#: A space before a character that is no white space always begins a pre-token of the patterns that take one space with a word.
_CUT = re.compile(r" (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def stand_ins(pattern: str) -> dict[int, str]:
    """A character of the same class for each that the tiktoken library, whose Unicode tables are older, puts into another class than the regex module does.

    Only characters that are newer than Python's own tables can be meant. A probe
    vocabulary shows whether the pattern takes one together with a letter or a digit.
    """
    import regex
    import tiktoken

    new = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn"]
    new = [c for c in regex.findall(r"[^\p{Cn}\p{Cs}]", "".join(new))]
    ranks = {bytes([b]): b for b in range(256)}
    for text in (c + kind for c in new for kind in "a1"):
        ranks[text.encode()] = len(ranks)
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    whole = {kind: probe.encode_ordinary_batch([c + kind for c in new], num_threads=1) for kind in "a1"}
    return {ord(c): "a" if len(letter) == 1 else "1" if len(digit) == 1 else "!" for c, letter, digit in zip(new, whole["a"], whole["1"], strict=True)}


class RankQueue:
    """Buckets of places by rank; a word of marks for each 64 buckets, and such words for the words, up to one."""

    def __init__(self, n_ranks: int):
        self.runs: dict[int, np.ndarray] = {}
        self.buckets: dict[int, list[int]] = {}
        self.levels = [[0] * -(-n_ranks // 64)]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * -(-len(self.levels[-1]) // 64))

    def fill(self, ranks: np.ndarray) -> None:
        """Put in all places of an array of ranks, where negative ones are none."""
        places = np.flatnonzero(ranks >= 0)
        if not len(places):
            return
        order = places[np.argsort(ranks[places], kind="stable")]
        found, begins = np.unique(ranks[order], return_index=True)
        for rank, run in zip(found.tolist(), np.split(order, begins[1:]), strict=True):
            self.runs[rank] = run
            self._mark(rank)

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [place]
            self._mark(rank)
        else:
            bucket.append(place)

    def _mark(self, rank: int) -> None:
        for words in self.levels:
            rank, bit = rank >> 6, 1 << (rank & 63)
            before = words[rank]
            words[rank] = before | bit
            if before:
                return

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The least rank and its places in order, or None; its bucket is empty then."""
        rank = 0
        for words in reversed(self.levels):
            word = words[rank]
            if not word:
                return None
            rank = rank << 6 | (word & -word).bit_length() - 1
        run, bucket, at = self.runs.pop(rank, None), self.buckets.pop(rank, None), rank
        for words in self.levels:
            at, bit = at >> 6, 1 << (at & 63)
            words[at] ^= bit
            if words[at]:
                break
        if bucket is None:
            return rank, run
        places = np.array(bucket)
        return rank, (places if len(bucket) == 1 else np.unique(places)) if run is None else np.union1d(run, places)


class ByteBPE:
    """A vocabulary of ranks, which are the ids, and its pattern of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pattern, self.stand_ins = pattern, None
        self.queue = RankQueue(max(self.tokens) + 1)
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pair_keys, self.pair_ranks = np.array(pairs or [(-2, -1)], dtype=np.int64).T.copy()
        # Ranks whose token can form a pair of a lower rank: their merges need a look at what they bring.
        left, right = self.pair_keys >> 32, self.pair_keys & 0xFFFFFFFF
        self.unsafe = {*left[left > self.pair_ranks].tolist(), *right[right > self.pair_ranks].tolist()}
        self.begin: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or -1."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens (not empty), one after the other, and where each one's begin, and their end.

        All pre-tokens of a call stand in one linked list, cut between them. A token is
        known by the place of its first byte. Place n is beyond every end.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n, ends = int(lengths.sum()), np.cumsum(lengths)
        begins = ends - lengths
        ids = np.append(self.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[begins] = n, n
        alive = np.ones(n + 1, dtype=bool)
        waiting = np.append(self.pair_rank(ids[:-1], ids[after[:-1]]), -1)
        queue = self.queue
        queue.fill(waiting)
        while (entry := queue.pop()) is not None:
            rank, at = entry
            at = at[waiting[at] == rank]  # others are stale
            if not len(at):
                continue
            if len(at) > 1:
                due, follows = at, after[at[:-1]] == at[1:]
                if follows.any():  # of pairs that overlap, every second one
                    k = np.arange(len(at))
                    at = at[(k - np.maximum.accumulate(np.where(np.append(False, follows), 0, k))) % 2 == 0]
                if rank in self.unsafe:
                    # A merge that makes a pair of a lower rank must be the last one of its pre-token until that pair is merged.
                    left = np.where(np.append(-1, after[at[:-1]]) == before[at], rank, ids[before[at]])
                    lower = [self.pair_rank(*pair) for pair in ((np.full_like(at, rank), ids[after[after[at]]]), (left, np.full_like(at, rank)))]
                    stops = ((lower[0] >= 0) & (lower[0] < rank)) | ((lower[1] >= 0) & (lower[1] < rank))
                    if stops.any():
                        piece = np.searchsorted(ends, at, side="right")
                        passed = np.cumsum(stops) - stops
                        at = at[passed == passed[np.searchsorted(piece, piece)]]
                        for place in np.setdiff1d(due, at).tolist():
                            queue.push(rank, place)
            gone = after[at]
            right = after[gone]
            ids[at], waiting[gone], alive[gone] = rank, -1, False
            after[at], before[right] = right, at
            left = before[at]
            places = np.concatenate([at, left[left < n]])
            ranks = self.pair_rank(ids[places], ids[after[places]])
            waiting[places] = ranks
            found = ranks >= 0
            for r, place in zip(ranks[found].tolist(), places[found].tolist(), strict=True):
                queue.push(r, place)
        alive[n] = False
        return ids[alive], np.concatenate([[0], np.cumsum(alive)[ends - 1]])

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if text.isascii() or not any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self.find(text)
        if self.stand_ins is None:
            self.stand_ins = stand_ins(self.pattern)
        ends = list(accumulate(map(len, self.find(text.translate(self.stand_ins)))))
        return [text[a:b] for a, b in pairwise([0, *ends])]

    def _learned(self, begin: set[str], later: set[str]) -> None:
        """Put the ids of chunks into the memos."""
        whole, new = self.ranks.get, {}

        def place(piece: str) -> int:
            """The number of a pre-token in new, or the inverse of its id."""
            raw = piece.encode()
            rank = whole(raw)
            return new.setdefault(raw, len(new)) if rank is None else ~rank

        begin, later = list(begin), list(later)
        places = [[place(piece) for piece in self.pieces(chunk)] for chunk in begin]
        found = iter(self.pieces("".join([f" {chunk}" for chunk in later])))
        for chunk in later:
            piece = next(found)
            if (size := len(piece)) > len(chunk):
                places.append(place(piece))
                continue
            mine = [place(piece)]
            while size <= len(chunk):
                piece = next(found)
                mine.append(place(piece))
                size += len(piece)
            places.append(mine)
        ids, at = self.merged(list(new)) if new else (np.zeros(0), np.zeros(1, np.int64))
        raw = ids.astype("<u4").tobytes()
        own = [raw[a:b] for a, b in pairwise((at * 4).tolist())]
        one = lambda p: own[p] if p >= 0 else (~p).to_bytes(4, "little")
        known = [one(p) if type(p) is int else b"".join([one(x) for x in p]) for p in places]
        self.begin |= zip(begin, known[: len(begin)], strict=True)
        self.later |= zip(later, known[len(begin) :], strict=True)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        begin, later = set(), set()
        for text in texts:
            first, *rest = _CUT.split(text)
            begin.add(first)
            later.update(rest)
        if len(self.begin) > MEMO:
            self.begin = {}
        if len(self.later) > MEMO:  # what these texts have is likely to be met again
            self.later = {chunk: ids for chunk, ids in self.later.items() if chunk in later}
        begin, later = begin - self.begin.keys(), later - self.later.keys()
        self._learned(begin, later)
        out = []
        for text in texts:
            first, *rest = _CUT.split(text)
            out.append(self.begin[first] + b"".join(map(self.later.__getitem__, rest)))
        for memo, new in ((self.begin, begin), (self.later, later)):
            for chunk in new:
                if len(chunk) > SHORT:
                    del memo[chunk]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; raises KeyError for one that the vocabulary lacks."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_known: dict[tuple[str, str], ByteBPE] = {}


def vocabulary(ranks_path: str, pattern: str) -> ByteBPE:
    """One vocabulary for each worker process."""
    if (ranks_path, pattern) not in _known:
        _known[ranks_path, pattern] = ByteBPE(read_ranks(ranks_path), pattern)
    return _known[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, column: str = "text") -> DataFrame:
    """docs with ids (little-endian unsigned 32-bit integers, binary) in place of the text column.

    Rows keep their other columns, which must not be called ids, and stay in their
    partitions; nothing is shuffled. A null text counts as an empty one, and an empty one
    has no ids. Special tokens do not exist: their strings are plain text. Repeated rows
    are encoded each; a text of any length is encoded whole, in some fifty bytes of
    memory for each byte of its distinct words. pattern: one that takes at most one space
    before a word into a pre-token, as public_tokenizers.PATTERN does.
    """
    out = docs.drop(column)
    kept = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(ranks_path, pattern)
        for whole in batches:
            for batch in text_slices(whole, column, TOGETHER):
                ids = bpe.encode([t.as_py() or "" for t in batch.column(column)])
                yield pa.record_batch({c: batch.column(c) for c in kept} | {"ids": pa.array(ids, pa.binary())})

    return docs.mapInArrow(run, extended(out, "ids binary"))


def decode(encoded: DataFrame, ranks_path: str, pattern: str, column: str = "ids") -> DataFrame:
    """encoded with decoded (binary) in place of its ids. Null ids stay null; an id that the vocabulary lacks fails the query."""
    out = encoded.drop(column)
    kept = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(ranks_path, pattern)
        for whole in batches:
            for batch in text_slices(whole, column):
                found = [None if not i.is_valid else bpe.decode(i.as_py()) for i in batch.column(column)]
                yield pa.record_batch({c: batch.column(c) for c in kept} | {"decoded": pa.array(found, pa.binary())})

    return encoded.mapInArrow(run, extended(out, "decoded binary"))


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document of the table encoded and decoded: digests of its ids and of the bytes that they stand for."""
    import public_tokenizers as P

    ranks, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    ids = ids.select("doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(ids, ranks, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
