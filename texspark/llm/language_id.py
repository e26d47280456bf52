"""Language mixtures by expectation-maximisation over n-gram likelihoods.

Each language has a character trigram model, trained from a bounded sample of rows with a
known language. A word's likelihood under a language is that of its trigrams; a
document's language shares are those that make its words most likely, found by
expectation-maximisation. From all languages down to one, the least language is dropped
(and with it those that account for no word) and the shares are found again; the set kept
is the one with the best likelihood after a penalty for each language (the Bayesian
information criterion).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texspark.llm.common import extended, id_crc, table, text_slices

#: Letters fall into this many classes, besides that of all other characters.
CLASSES = 64
#: Rows of each language that the models are trained on, at most (about; rows are chosen by hash).
SAMPLE = 4000
#: Languages that are learned, at most: those with most rows (a megabyte of model each).
LANGUAGES = 64
ROUNDS = 12
#: A text's shares stand still if none moves by more in a round.
STILL = 1e-7
#: A language that accounts for fewer words than this is dropped with the least one: it adds less to the likelihood than its penalty.
FAINT = 1e-3
_CELLS = CLASSES**3


@functools.lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """The class of each code point: 0 if it is no letter, 1 to 26 for a to z, else by a hash."""
    points = np.arange(0x110000, dtype=np.int64)
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    classes = np.where(letters, 27 + (points * 40503 >> 4) % (CLASSES - 27), 0).astype(np.int32)
    for c in range(26):
        classes[[ord("a") + c, ord("A") + c]] = c + 1
    return classes


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined up: each word's first trigram, and each text's first word; and all trigrams."""
    lowered = [t.lower() for t in texts]
    joined = " " + " ".join(lowered) + "  "
    classes = letter_classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    middle = classes[1:-1]
    grams = (classes[:-2] * CLASSES + middle) * CLASSES + classes[2:]
    inside = np.flatnonzero(middle)
    begins = 1 + np.cumsum([0] + [len(t) + 1 for t in lowered])  # a text's place in joined
    is_first = classes[inside] == 0  # the character before is no letter
    words = np.flatnonzero(is_first)
    return grams[inside], words, np.searchsorted(inside[words] + 1, begins)


def trained(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and the log likelihood of each trigram given its first two letters, by language."""
    rows = docs.where("lang is not null and text is not null")
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r.lang: r.n for r in most.collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((_CELLS, 0), np.float32)
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, sample / n)) for k, n in counts.items()], "lang string, share double")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for part in text_slices(batch):
                names = part.column("lang").to_pylist()
                for lang in set(names):
                    grams, *_ = trigrams([t for t, x in zip(part.column("text").to_pylist(), names, strict=True) if x == lang])
                    sums[lang] = sums.get(lang, 0) + np.bincount(grams, minlength=_CELLS)
        for lang, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.record_batch({"lang": pa.array([lang] * len(some), pa.string()), "gram": pa.array(some, pa.int64()), "n": pa.array(n[some], pa.int64())})

    table_ = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts_ = np.zeros((len(languages), _CELLS))
    which = np.searchsorted(np.array(languages), np.array(table_["lang"].to_pylist(), dtype=np.array(languages).dtype)) if table_.num_rows else np.zeros(0, int)
    counts_[which, table_["gram"].to_numpy()] = table_["n"].to_numpy()
    by_pair = counts_.reshape(len(languages), CLASSES * CLASSES, CLASSES)
    single = counts_.reshape(len(languages), -1, CLASSES).sum(axis=1) + 0.5
    single /= single.sum(axis=1, keepdims=True)
    smooth = 2.0
    likely = (by_pair + smooth * single[:, None, :]) / (by_pair.sum(axis=2, keepdims=True) + smooth)
    return languages, np.log(likely).reshape(len(languages), _CELLS).T.astype(np.float32).copy()


def settled(likely: np.ndarray, active: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shares (language, text) of the active languages after ROUNDS rounds; a text whose shares stand still needs no more of them."""
    pi = active / active.sum(axis=0)
    out, left = pi.copy(), np.arange(len(sizes))
    rows, owner = np.cumsum(sizes) - sizes, np.repeat(left, sizes)
    for _ in range(ROUNDS):
        joint = likely * pi[:, owner]
        joint /= joint.sum(axis=0)
        new = np.where(active, np.maximum(np.add.reduceat(joint, rows, axis=1) / sizes, 1e-9), 0)
        new /= new.sum(axis=0)
        out[:, left] = new
        moving = np.abs(new - pi).max(axis=0) > STILL
        pi = new
        if not moving.any():
            break
        if 2 * sizes[moving].sum() < sizes.sum():
            likely, active, pi, left, sizes = likely[:, moving[owner]], active[:, moving], pi[:, moving], left[moving], sizes[moving]
            rows, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    return out


def mixtures(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Each text's language shares (rows sum to 1; all 0 without a letter)."""
    n_lang = model.shape[1]
    shares = np.zeros((len(texts), n_lang))
    grams, words, begins = trigrams(texts)
    sizes = np.diff(begins)
    some = np.flatnonzero(sizes)
    if not len(some) or not n_lang:
        return shares
    logs = np.add.reduceat(model[grams], words, axis=0).T.astype(np.float64, order="C")
    logs -= logs.max(axis=0)
    likely = np.exp(np.maximum(logs, -30))  # of each word, against its best language
    left, sizes = some, sizes[some]
    active, best_score = np.ones((n_lang, len(some)), dtype=bool), np.full(len(texts), -np.inf)
    while len(left):
        pi = settled(likely, active, sizes)
        owner = np.repeat(np.arange(len(left)), sizes)
        fit = np.add.reduceat(np.log((likely * pi[:, owner]).sum(axis=0)), np.cumsum(sizes) - sizes) - 0.5 * (active.sum(axis=0) - 1) * np.log(sizes + 1.0)
        better = fit > best_score[left]
        shares[left[better]], best_score[left[better]] = pi[:, better].T, fit[better]
        active[np.where(active, pi, np.inf).argmin(axis=0), np.arange(len(left))] = False
        active &= pi * sizes >= FAINT
        more = active.any(axis=0)
        if not more.all():
            likely, active, left, sizes = likely[:, more[owner]], active[:, more], left[more], sizes[more]
    return shares


def identify(docs: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """docs (any columns, text among them) with lang_pred, score and mixture.

    lang_pred is the language with the largest share and score that share; mixture maps
    the languages of the chosen set to their shares. Texts that are null or have no
    letter get `und`, 0 and an empty map, and so do all if no language was learned.
    Of equal shares the first language by code points counts. Repeated rows are judged
    once each; an empty table gives no rows. Columns of docs named like the new ones are
    replaced. A text is held whole by a task, as some 40 bytes of arrays for each letter.
    """
    docs = docs.drop("lang_pred", "score", "mixture")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                shares = mixtures([t or "" for t in part.column("text").to_pylist()], sent.value)
                top = shares.argmax(axis=1) if languages else np.zeros(len(shares), int)
                score = shares[np.arange(len(shares)), top] if languages else np.zeros(len(shares))
                names = [languages[k] if s > 0 else "und" for k, s in zip(top.tolist(), score.tolist(), strict=True)]
                maps = [[(languages[k], float(row[k])) for k in np.flatnonzero(row > 1e-6)] for row in shares]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(maps, pa.map_(pa.string(), pa.float64()))], [*part.schema.names, "lang_pred", "score", "mixture"])

    return docs.mapInArrow(judge, extended(docs, "lang_pred string, score double, mixture map<string,double>"))


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", id_crc(F.col("doc_id")) % 4 == 2)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    docs = held_out(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = trained(docs.where("not held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), *model).select("doc_id", "held_out", "lang_pred", "score")
