"""Cross-tokenizer alignment: which ids of two vocabularies stand for the same bytes, and in how many documents.

A text is encoded by a byte-level BPE (A, with a space before it) and by a sentencepiece
model (B, which adds that space). Where tokens of both end at one byte, the text is cut
into groups; each A token and each B token of a group are linked. A pair of ids is one
packed int64 (A id in the upper 32 bits).

First job: each task counts the documents of its pairs by np.unique, and writes partial
counts. Second job: a global sort by ranges of keys and a run-length sum of equal keys;
each task leaves a shard of sorted keys and counts in the shared folder. Third job: the
texts are encoded again (their links would take several times their room), and counts are
looked up by searchsorted in the shards, mapped into memory.

Texts are cut before single spaces between words: no token of either vocabulary spans
one, so a word's groups are found once and remembered.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texspark.llm.byte_bpe import read_ranks
from texspark.llm.common import extended, given_back, saved, shared_dir, table, text_slices
from texspark.llm.packing import PATTERN, encoder

_CUT = re.compile(r" (?=\S)(?<=\S )")  # a space first: it is what the search looks for
#: Words that a worker remembers, bytes of text whose words are learned together, bytes of words that are encoded together, and pairs that it counts before it sorts them.
MEMO, TOGETHER, JOINED, PENDING = 1 << 18, 8 << 20, 1 << 18, 1 << 22
#: Links of a group that are made one by one; of larger groups, distinct ids are paired and the links counted.
LINKS = 1 << 16


class Aligner:
    """Two vocabularies."""

    def __init__(self, ranks_path: str, pattern: str, model_path: str):
        import sentencepiece

        self.a = encoder(ranks_path, pattern, ())
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.a_bytes = {rank: token for token, rank in read_ranks(ranks_path).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = dict(enumerate(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)))
        self.sizes = [np.array([len(x.get(i, b"")) for i in range(max(x) + 1)]) for x in (self.a_bytes, self.b_bytes)]
        self.cut = _CUT.split if not any(re.search("[^▁]▁", p) for p in pieces) else lambda text: [text]

    def align(self, words: list[str], spelled: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """For words in order: [A tokens, B tokens, groups, links] (zeros where the bytes differ); their pairs, how often each is linked, and where each word's end; their groups as text, if asked for."""
        parts, held, size = [], [], 0
        for word in words:
            alone = word != word.strip() or not word
            if held and (alone or size > JOINED):
                parts.append(held)
                held, size = [], 0
            held.append(word)
            size += len(word)
            if alone:
                parts.append(held)
                held, size = [], 0
        done = [x for part in [*parts, held] if part for x in self._joined(part, spelled)]
        none = np.zeros(0, np.int64)
        sizes, pairs, times, counts = (np.concatenate([x[k] for x in done]) if done else none.reshape(0, 4) if k == 0 else none for k in range(4))
        return sizes, pairs, times, np.cumsum(counts), [t for x in done for t in x[4]]

    def _joined(self, words: list[str], spelled: bool) -> list[tuple]:
        """Words encoded as one text, which changes no id; in halves, if its bytes change on the way."""
        text = " ".join(words)
        raw = f" {text}".encode()
        b = [] if "▁" in text else self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            if len(words) > 1:
                return [x for half in (words[: len(words) // 2], words[len(words) // 2 :]) for x in self._joined(half, spelled)]
            return [(np.zeros((1, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), [""])]
        ids = np.frombuffer(self.a.ordinary(f" {text}"), self.a.dtype).astype(np.int64), np.array(b, np.int64)
        ends = [np.cumsum(sizes[i]) for sizes, i in zip(self.sizes, ids, strict=True)]
        common = np.intersect1d(*ends, assume_unique=True)
        word_ends = np.cumsum([len(w.encode()) + 1 for w in words])
        group_a, group_b = (np.searchsorted(common, e) for e in ends)
        n_a, n_b = (np.bincount(g, minlength=len(common)) for g in (group_a, group_b))
        word = np.searchsorted(word_ends, common)
        per_word = lambda x: np.bincount(word, x, minlength=len(words)).astype(np.int64)
        sizes = np.stack([per_word(n_a), per_word(n_b), per_word(np.ones(len(common))), per_word(n_a * n_b)], axis=1)
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        few = n_a * n_b <= LINKS
        each = np.where(few, n_b, 0)[group_a]  # links of each A token
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - first_b[group_a], each)
        pairs, times, whose = np.repeat(ids[0], each) << 32 | ids[1][at], np.ones(len(at), np.int64), np.repeat(word[group_a], each)
        for g in np.flatnonzero(~few):
            (xs, nx), (ys, ny) = (np.unique(i[f : f + n], return_counts=True) for i, f, n in ((ids[0], first_a[g], n_a[g]), (ids[1], first_b[g], n_b[g])))
            pairs, times = np.append(pairs, (xs[:, None] << 32 | ys).ravel()), np.append(times, (nx[:, None] * ny).ravel())
            whose = np.append(whose, np.full(len(xs) * len(ys), word[g]))
        if not few.all():
            order = np.argsort(whose, kind="stable")
            pairs, times, whose = pairs[order], times[order], whose[order]
        return [(sizes, pairs, times, np.bincount(whose, minlength=len(words)), self._spelled(ids, n_a, n_b, per_word(np.ones(len(common)))) if spelled else [])]

    @staticmethod
    def _spelled(ids: tuple[np.ndarray, np.ndarray], n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray) -> list[str]:
        a, b = (list(map(str, i.tolist())) for i in ids)
        groups, i, j = [], 0, 0
        for x, y in zip(n_a.tolist(), n_b.tolist(), strict=True):
            groups.append(f"{a[i]}|{b[j]}" if x == y == 1 else f"{','.join(a[i : i + x])}|{','.join(b[j : j + y])}")
            i, j = i + x, j + y
        ends = np.cumsum(n_groups).tolist()
        return [";".join(groups[k:end]) for k, end in zip([0, *ends], ends, strict=False)]


_known: dict[tuple, Aligner] = {}


def aligner(*paths: str) -> Aligner:
    """One for each worker process."""
    if paths not in _known:
        _known[paths] = Aligner(*paths)
    return _known[paths]


def known_words(texts: list[str | None], index: dict[str, int], both: Aligner) -> tuple[list[list[str]], list[str], list[str] | None]:
    """The words of each text, those that the index lacks, and, if it holds too many, those of it that are to be kept."""
    words = [both.cut(t) if t else [] for t in texts]
    met: set[str] = set()
    for some in words:
        met.update(some)
    return words, list(met - index.keys()), [w for w in met if w in index] if len(index) > MEMO else None


def ragged(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places of the elements of lists number `at`, whose ends are given."""
    size = ends[at] - np.where(at > 0, ends[at - 1], 0)
    return np.repeat(ends[at] - np.cumsum(size), size) + np.arange(size.sum())


class Pairs:
    """For each known word its distinct pairs."""

    def __init__(self, both: Aligner):
        self.both, self.index = both, {}
        self.good, self.pairs, self.ends = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The distinct pairs of each text; none for one without tokens."""
        words, new, kept = known_words(texts, self.index, self.both)
        if kept is not None:
            at = np.array([self.index[w] for w in kept], np.int64)
            sizes = self.ends[at] - np.where(at > 0, self.ends[at - 1], 0)
            self.index, self.good, self.pairs, self.ends = dict(zip(kept, range(len(kept)), strict=True)), self.good[at], self.pairs[ragged(self.ends, at)], np.cumsum(sizes)
        if new:
            sizes, pairs, _, ends, _ = self.both.align(new, False)
            self.index |= zip(new, range(len(self.index), len(self.index) + len(new)), strict=True)
            self.good, self.ends, self.pairs = np.append(self.good, sizes[:, 0] > 0), np.append(self.ends, ends + len(self.pairs)), np.append(self.pairs, pairs)
        for some in words:
            at = np.unique(np.fromiter(map(self.index.__getitem__, some), np.int64, len(some)))
            yield np.unique(self.pairs[ragged(self.ends, at)]) if self.good[at].all() else self.pairs[:0]


class Alignments:
    """For each known word [A tokens, B tokens, groups, links, best links, sum of counts] and its groups."""

    def __init__(self, both: Aligner, counts, highest: np.ndarray):
        self.both, self.counts, self.highest = both, counts, highest
        self.index, self.sizes, self.texts = {}, np.zeros((0, 6), np.int64), []

    def of(self, texts: list[str | None]) -> Iterator[tuple]:
        """The six numbers and the groups of each text."""
        words, new, kept = known_words(texts, self.index, self.both)
        if kept is not None:
            at = [self.index[w] for w in kept]
            self.index, self.sizes, self.texts = dict(zip(kept, range(len(kept)), strict=True)), self.sizes[at], [self.texts[k] for k in at]
        if new:
            sizes, pairs, times, ends, texts_ = self.both.align(new, True)
            distinct, inverse = np.unique(pairs, return_inverse=True)
            n = self.counts(distinct)
            links = np.stack([(n == self.highest[distinct >> 32]).astype(np.int64)[inverse], n[inverse]], axis=1) * times[:, None]
            upto = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(links, axis=0)])
            self.index |= zip(new, range(len(self.index), len(self.index) + len(new)), strict=True)
            self.sizes = np.concatenate([self.sizes, np.concatenate([sizes, np.diff(upto[np.append(0, ends)], axis=0)], axis=1)])
            self.texts += texts_
        for some in words:
            at = list(map(self.index.__getitem__, some))
            sizes = self.sizes[at]
            yield (*sizes.sum(axis=0).tolist(), ";".join(map(self.texts.__getitem__, at))) if len(at) and sizes[:, 0].all() else (0, 0, 0, 0, 0, 0, "")


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    begins = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[begins], np.add.reduceat(n[order], begins) if len(k) else n


def partial_counts(docs: DataFrame, paths: tuple[str, str, str]) -> DataFrame:
    """Rows (pair, n): in how many documents of a task each pair is linked; a task may give a pair more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pending, waiting = Pairs(aligner(*paths)), [], 0
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def settled() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(pending), return_counts=True) if pending else (keys[:0], counts[:0])
            return summed([keys, new], [counts, n])

        for whole in batches:
            for batch in text_slices(whole, "text", TOGETHER):
                for found in known.of(batch.column("text").to_pylist()):
                    pending.append(found)
                    waiting += len(found)
                    if waiting > PENDING:
                        (keys, counts), pending, waiting = settled(), [], 0
                        if len(keys) > 2 * PENDING:
                            yield pa.record_batch({"pair": pa.array(keys), "n": pa.array(counts)})
                            keys, counts = keys[:0], counts[:0]
        keys, counts = settled()
        for k in range(0, len(keys), 1 << 16):
            yield pa.record_batch({"pair": pa.array(keys[k : k + (1 << 16)]), "n": pa.array(counts[k : k + (1 << 16)])})
        given_back()

    return docs.select("text").mapInArrow(run, "pair long, n long")


def shards(partial: DataFrame, folder: str) -> DataFrame:
    """Sum the counts of equal pairs and leave them in order in files of a shared folder.

    Rows (first, last, size, keys, counts, ids, best): a shard's range of pairs, its two
    files, and for its A ids the largest count. A task writes files of its own names, so
    one that runs again does no harm; only those named in the result count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}"
        first, last, size, held, best = None, None, 0, None, {}
        with store.open_output_stream(f"{name}.keys") as to_keys, store.open_output_stream(f"{name}.counts") as to_counts:

            def put(keys: np.ndarray, counts: np.ndarray) -> None:
                nonlocal first, last, size
                if len(keys):
                    first, last, size = int(keys[0]) if first is None else first, int(keys[-1]), size + len(keys)
                    to_keys.write(keys.astype("<i8").tobytes())
                    to_counts.write(counts.astype("<i8").tobytes())
                    ids = keys >> 32
                    begins = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                    for i, n in zip(ids[begins].tolist(), np.maximum.reduceat(counts, begins).tolist(), strict=True):
                        best[i] = max(n, best.get(i, 0))

            for batch in batches:
                keys, counts = (batch.column(c).to_numpy() for c in ("pair", "n"))
                if not len(keys):
                    continue
                if held:  # the last pair of a batch may go on in the next
                    keys, counts = np.append(held[0], keys), np.append(held[1], counts)
                begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                keys, counts = keys[begins], np.add.reduceat(counts, begins)
                put(keys[:-1], counts[:-1])
                held = keys[-1], counts[-1]
            if held:
                put(np.array([held[0]], np.int64), np.array([held[1]], np.int64))
        if size:
            uri = f"{folder}/{name.rpartition('/')[2]}"
            yield pa.RecordBatch.from_pylist([{"first": first, "last": last, "size": size, "keys": f"{uri}.keys", "counts": f"{uri}.counts", "ids": list(best), "best": list(best.values())}], schema=arrow)

    longs = pa.list_(pa.int64())
    arrow = pa.schema([("first", pa.int64()), ("last", pa.int64()), ("size", pa.int64()), ("keys", pa.string()), ("counts", pa.string()), ("ids", longs), ("best", longs)])
    return partial.repartitionByRange("pair").sortWithinPartitions("pair").mapInArrow(run, "first long, last long, size long, keys string, counts string, ids array<long>, best array<long>")


def _mapped(uri: str) -> np.ndarray:
    """A file of int64: mapped into memory where the shared folder is a path, else read."""
    store, path = pafs.FileSystem.from_uri(uri)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype="<i8", mode="r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype="<i8")


class Counts:
    """Lookup in the shards; rows of shards() in order."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.files = sorted(rows), {}
        self.firsts = np.array([r[0] for r in self.rows], np.int64)

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), np.int64)
        shard = np.searchsorted(self.firsts, pairs, side="right") - 1
        for k in np.unique(shard[shard >= 0]).tolist():
            if k not in self.files:
                if self.files and not isinstance(next(iter(self.files.values()))[0], np.memmap):
                    self.files.clear()  # files that had to be read are held one at a time
                self.files[k] = _mapped(self.rows[k][3]), _mapped(self.rows[k][4])
            keys, counts = self.files[k]
            mine = np.flatnonzero(shard == k)
            at = np.minimum(np.searchsorted(keys, pairs[mine]), len(keys) - 1)
            out[mine] = np.where(keys[at] == pairs[mine], counts[at], 0)
        return out


def align(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, counts_folder: str | None = None) -> DataFrame:
    """docs without text, and with n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups (string).

    A pair's count is the number of rows of docs that hold it linked. n_best: links whose
    count is their A id's highest, ties included; count_sum: the counts of all links,
    repeats included. groups: `a1,a2|b1;a3|b2,b3`. A null or empty text, and one whose
    bytes B changes, has no tokens: zeros and ''. Rows stay in their partitions, repeated
    ones count each; other columns are kept, and must not bear the new names. The pairs
    that exist are at most the product of the vocabularies, however many documents there
    are. A text is encoded whole; a word (without a single space) of n bytes takes memory
    for its tokens and the pairs of its groups. Shards go to counts_folder, by default
    one in the shared folder. Shard ranges and the largest counts of A ids reach the
    driver: a row for each shard and a number for each id of A.
    """
    paths = ranks_path, pattern, model_path
    folder = counts_folder or f"{shared_dir(docs.sparkSession)}/pairs-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows = saved(shards(saved(partial_counts(docs, paths), "partial"), folder), "shards").collect()
    best = np.zeros(1 + max((max(r.ids) for r in rows), default=0), np.int64)
    for r in rows:
        best[r.ids] = np.maximum(best[r.ids], r.best)
    known = docs.sparkSession.sparkContext.broadcast(([tuple(r)[:5] for r in rows], best))
    out = docs.drop("text")
    kept = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_rows, highest = known.value
        words = Alignments(aligner(*paths), Counts(shard_rows), highest)
        for whole in batches:
            for batch in text_slices(whole, "text", TOGETHER):
                result = list(words.of(batch.column("text").to_pylist()))
                columns = list(zip(*result, strict=True)) or [()] * 7
                yield pa.record_batch({c: batch.column(c) for c in kept} | {c: pa.array(v, pa.int64()) for c, v in zip(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), columns[:6], strict=True)} | {"groups": pa.array(columns[6], pa.string())})

    return docs.mapInArrow(run, extended(out, "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"))


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document of the table, aligned; its groups as a digest."""
    import public_tokenizers as P

    rows = align(table(spark, sf_dir, "documents").select("doc_id", "text"), P.path("byte_bpe_50k.tiktoken"), PATTERN, P.path("piece_bpe_32k.model"))
    return rows.withColumn("groups_sha256", F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))).drop("groups")
