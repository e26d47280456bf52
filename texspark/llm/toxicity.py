"""Toxicity by compression distance: one zstandard dictionary for each kind of text.

From a bounded sample of labelled rows, one dictionary is trained on ordinary windows and
one on the windows of toxic rows that ordinary rows lack (by a likelihood-ratio test of
their row counts; most of a toxic text is ordinary). A window is a word with a blank on
either side, padded, as the compressor finds no match in an input's last bytes. Its
distance is what it compresses to with the ordinary dictionary less what it compresses
to with the toxic text put after it. A logistic curve over how many of a text's windows
pass a few distances gives the score; it is fitted to rows that
the toxic dictionary has not seen, so that the threshold with their best F1 is at one half.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texspark.llm.common import dropped, extended, id_crc, saved, table, text_slices
from texspark.llm.shingles import hashed, word_spans

#: Labelled rows to learn from and their bytes, at most (about; rows are chosen by hash); ordinary snippets of ten words that a dictionary is trained on.
SAMPLE, SAMPLE_BYTES, SNIPPETS = 8000, 64 << 20, 40_000
#: Parts of the sample that take turns as unseen rows.
FOLDS = 5
#: Bytes of a dictionary, level, padding, and the distances that are counted.
DICTIONARY, LEVEL, PAD, PASSED = 16_384, 12, b"\0" * 10, (2, 3, 4, 5)
#: A toxic window's likelihood ratio and how much more frequent it is than in ordinary rows, at least.
RATIO, TIMES = 10.0, 4.0
_EDGES = b"\"'.,;:!?()[]{}<>*#$%&|"


def windows(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct windows of the texts, the window at each of their words, and each text's first word."""
    lower, first, last, begins = word_spans(column)
    _, at, which = np.unique(hashed(lower, first, last), return_index=True, return_inverse=True)
    raw = lower.tobytes()
    return [raw[a:b].strip(_EDGES) for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)], which, begins


class Distances:
    """Compression distances of windows with two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.compressors = [self.compressor(ordinary), self.compressor(ordinary + toxic)]

    @staticmethod
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0, np.int64)
        padded = [b" " + t + b" " + PAD for t in texts]
        sizes = np.array([len(p) for p in padded], dtype=np.uint64)
        spans = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1)
        plain, toxic = (c.multi_compress_to_buffer(zstandard.BufferWithSegments(b"".join(padded), spans.tobytes()), threads=1) for c in self.compressors)
        return np.fromiter((len(a) - len(b) for a, b in zip((plain[i] for i in range(len(texts))), (toxic[i] for i in range(len(texts))), strict=True)), dtype=np.int64, count=len(texts))


def features(column: pa.Array, distances: Distances) -> np.ndarray:
    """For each text: how many windows pass each distance, and its length, as logarithms and densities."""
    words, which, begins = windows(column)
    far = distances(words)[which]
    n = np.diff(begins).astype(float)
    counts = []
    for least in PASSED:
        total = np.concatenate([[0], np.cumsum(far >= least)])
        counts.append((total[begins[1:]] - total[begins[:-1]]).astype(float))
    return np.stack([*(np.log1p(c) for c in counts), *(c / np.sqrt(n + 1) for c in counts), np.log1p(n)], axis=1)


def trained_content(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's bytes; of too few samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic curve, the last one constant, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def ordinary_content(rows: list[list[bytes]]) -> bytes:
    """Trained content of ordinary rows, in snippets of ten windows."""
    plain = [b" ".join(words[k : k + 10]) for words in rows for k in range(0, len(words), 10)]
    return trained_content(plain[:: max(1, len(plain) // SNIPPETS)], DICTIONARY)


def toxic_content(seen: list[Counter], n: list[int], rows: list[list[bytes]]) -> bytes:
    """Trained content of the windows of toxic rows that ordinary rows lack, by the rows of either kind that have them."""
    share = n[1] / sum(n)

    def telling(word: bytes, a: int) -> bool:
        b = seen[0][word]
        e = (a + b) * share
        return a > TIMES * b * n[1] / n[0] and 2 * (a * math.log(a / e) + (b * math.log(b / (a + b - e)) if b else 0)) > RATIO

    toxic_words = {w for w, a in seen[1].items() if telling(w, a)}
    return trained_content([b" " + w + b" " for words in rows for w in words if w in toxic_words] * 4, DICTIONARY)


def learned(rows: pa.Table) -> dict:
    """The model of a sample (text, toxic).

    The curve and its threshold are fitted to features of rows that the toxic dictionary
    behind them has not seen, in FOLDS parts; the model's own dictionary is trained on all.
    """
    y = np.array([int(t == 1) for t in rows["toxic"].to_pylist()], dtype=np.int64)
    rare = {"rate": float(y.mean()) if len(y) else 0.0}
    if y.sum() < 2 or (1 - y).sum() < 2:
        return rare
    text = rows["text"].combine_chunks() if isinstance(rows["text"], pa.ChunkedArray) else rows["text"]
    held = []
    for k in range(0, len(y), 200):
        words, which, begins = windows(text.slice(k, 200))
        held += [[words[j] for j in which[a:b].tolist()] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    fold = np.zeros(len(y), dtype=np.int64)  # kinds are dealt evenly
    for kind in (0, 1):
        fold[y == kind] = np.arange((y == kind).sum()) % FOLDS
    seen, n = [[Counter() for _ in range(FOLDS)] for _ in range(2)], np.zeros((2, FOLDS), dtype=int)
    candidates = {w for words, kind in zip(held, y.tolist(), strict=True) if kind for w in words if len(w) >= 3}  # only these are counted
    for words, kind, f in zip(held, y.tolist(), fold.tolist(), strict=True):
        seen[kind][f].update(candidates.intersection(words))
        n[kind, f] += 1
    total = [sum(parts, Counter()) for parts in seen]
    ordinary = ordinary_content([words for words, kind in zip(held, y.tolist(), strict=True) if not kind])
    toxic_rows = [(words, f) for words, kind, f in zip(held, y.tolist(), fold.tolist(), strict=True) if kind]
    x = np.zeros((len(y), 2 * len(PASSED) + 1))
    for f in range(FOLDS):
        own, others = np.flatnonzero(fold == f), n.sum(axis=1) - n[:, f]
        if not len(own) or not others.all():
            continue
        distances = Distances(ordinary, toxic_content([t - parts[f] for t, parts in zip(total, seen, strict=True)], others.tolist(), [words for words, g in toxic_rows if g != f]))
        for k in range(0, len(own), 200):
            x[own[k : k + 200]] = features(text.take(pa.array(own[k : k + 200])), distances)
    toxic = toxic_content(total, n.sum(axis=1).tolist(), [words for words, _ in toxic_rows])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = logistic((x - mean) / spread, y)
    odds = ((x - mean) / spread) @ w[:-1] + w[-1]
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    cut = (odds[order[best]] + odds[order[min(best + 1, len(y) - 1)]]) / 2
    return rare | {"ordinary": ordinary, "toxic": toxic, "mean": mean, "spread": spread, "weights": w, "cut": float(cut)}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """A model from documents (doc_id, text) and labels (doc_id, toxic).

    Learns from about `sample` rows and `sample_bytes` bytes at most, chosen by hash; texts
    of more than a sixty-fourth of the bytes are not learned from. Repeated rows count
    once. Rows are chosen by their ids and the texts' hashes and lengths, so only chosen
    texts leave their tasks.
    """
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic")
    texts = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    slim = texts.select("doc_id", "key", F.octet_length("text").alias("bytes")).where(F.col("bytes") <= sample_bytes // 64)
    rows = saved(slim.distinct().join(known.distinct(), "doc_id"), "labelled-rows")
    size = rows.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    share = min(1.0, sample / max(1, size.n), sample_bytes / max(1, size.bytes or 0))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 20)) < share * (1 << 20)).select("doc_id", "key", "toxic")
    found = texts.join(F.broadcast(chosen), ["doc_id", "key"]).groupBy("doc_id", "key", "toxic").agg(F.first("text").alias("text")).toArrow()
    dropped(rows)
    return learned(found.sort_by([("doc_id", "ascending"), ("key", "ascending"), ("toxic", "ascending")]).select(["text", "toxic"]))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs (any columns, text among them) with score (0 to 1) and predicted (1 if score >= 0.5).

    Null and empty texts are scored as texts without words. A model of rows of one kind
    only scores everything by that kind's share. Repeated rows are scored once each; an
    empty table gives no rows. A text is held whole by a task. Columns of docs named like the new ones are replaced.
    """
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        distances = Distances(m["ordinary"], m["toxic"]) if "weights" in m else None
        for batch in batches:
            for part in text_slices(batch, limit=2 << 20):
                if distances:
                    x = (features(part.column("text"), distances) - m["mean"]) / m["spread"]
                    scores = 1 / (1 + np.exp(-np.clip(x @ m["weights"][:-1] + m["weights"][-1] - m["cut"], -30, 30)))
                else:
                    scores = np.full(part.num_rows, m["rate"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, extended(docs, "score double, predicted int"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", id_crc(F.col("doc_id")) % 5 == 0)
    model = train(docs.where("not held_out"), table(spark, sf_dir, "labels").where(id_crc(F.col("doc_id")) % 5 != 0))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")
