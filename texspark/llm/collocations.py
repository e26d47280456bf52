"""Phrases whose words stand together more often than chance would have it.

First pass: each task counts all its phrases (words too) in a count-min sketch; the
sketches are merged by blocks of cells, and only whether a cell has reached the least
count is kept, one bit. A sketch never undercounts, so each frequent phrase has all its
bits. Second pass: phrases whose bits are set, and those of the phrases inside them, are
counted exactly. Then candidates are scored by their weakest cut, and those that a longer
one explains are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from texspark.llm.common import saved, table, text_slices

#: Cells of a block of the merge; at most so many cells in a row of the sketch (two rows, each four bytes a cell in a task); phrases for a cell at most, as long as there are that many cells.
BLOCK, MOST_CELLS, LOAD = 1 << 16, 1 << 25, 64
#: Bytes of text whose words stand in one array, and phrases that a task counts before it hands them on.
TOGETHER, HELD = 8 << 20, 1 << 18
#: Tasks a core that read texts, at most, and distinct phrases whose counts a task of the second pass keeps in arrays before it hands them on.
TASKS, KEPT = 2, 1 << 20
#: Odd multipliers: of a word to the hash of a phrase, and of a phrase to its cells.
STEP, ROWS = 0x9E3779B97F4A7C15, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
# The marks that end a piece of text, next to line breaks.
ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ENDS, b"abcdefghijklmnopqrstuvwxyz" + b"." * len(ENDS))


class _Words(dict):
    """Numbers of words; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self.hashes)
        self.hashes.append(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
        return self[word]


def _numbered(batches: Iterator[pa.RecordBatch], words: _Words) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, numbers of its words in order, the words' hashes) of some megabytes of text at a time."""
    for whole in batches:
        for batch in text_slices(whole, "text", TOGETHER):
            if len(words) > 4 * HELD:
                words.clear()
                words.__init__()
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if text.is_valid:
                    texts.setdefault(lang, []).append(text.as_py().encode())
            for lang, some in texts.items():
                found = b".".join(some).translate(_FOLD).replace(b".", b" . ").split()
                at = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
                seed = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
                yield lang, at, np.array(words.hashes, np.uint64)[at] ^ np.uint64(seed)


def _cells(phrases: np.ndarray, row: int, bits: int) -> np.ndarray:
    mixed = (phrases ^ (phrases >> np.uint64(31))) * np.uint64(ROWS[row])
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _longer(phrases: np.ndarray, hashes: np.ndarray, next_word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word each."""
    mixed = phrases * np.uint64(STEP)
    return (mixed ^ (mixed >> np.uint64(29))) + hashes[next_word] * np.uint64(0xFF51AFD7ED558CCD)


def sketch(docs: DataFrame, longest: int, least: int, bits: int) -> DataFrame:
    """Rows (block, marks, lang, n): bit by bit, the cells of a block that have reached `least`; and under block -1 each language's words."""
    kind = np.uint8 if least <= 255 else np.uint32
    top, size, n_rows = np.iinfo(kind).max, 1 << bits, len(ROWS)
    block = min(BLOCK, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((n_rows, size), np.uint32)
        totals: dict[str, int] = {}
        for lang, at, hashes in _numbered(batches, _Words()):
            places = np.flatnonzero(at)
            totals[lang] = totals.get(lang, 0) + len(places)
            phrases = hashes[places]
            for n in range(1, longest + 1):
                for row in range(n_rows):
                    np.add.at(cells[row], _cells(phrases, row, bits), np.uint32(1))
                if n < longest:
                    going = np.flatnonzero((places + n < len(at)) & (at[np.minimum(places + n, len(at) - 1)] != 0))
                    places = places[going]
                    phrases = _longer(phrases[going], hashes, places + n)
        press = zstandard.ZstdCompressor(level=1).compress
        for lang, n in totals.items():
            yield pa.record_batch({"block": pa.array([-1], pa.int32()), "cells": pa.array([None], pa.binary()), "lang": pa.array([lang], pa.string()), "n": pa.array([n], pa.int64())})
        if totals:
            for k, part in enumerate(np.split(cells.reshape(-1), n_rows * size // block)):
                packed = press(np.minimum(part, top).astype(kind).tobytes())
                yield pa.record_batch({"block": pa.array([k], pa.int32()), "cells": pa.array([packed], pa.binary()), "lang": pa.array([None], pa.string()), "n": pa.array([None], pa.int64())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial sketches that come block by block; one block is held at a time."""
        at, sums, totals = None, None, {}
        unpress = zstandard.ZstdDecompressor().decompress

        def done() -> Iterator[pa.RecordBatch]:
            if at is not None:
                yield pa.record_batch({"block": pa.array([at], pa.int32()), "marks": pa.array([np.packbits(sums >= least).tobytes()], pa.binary()), "lang": pa.array([None], pa.string()), "n": pa.array([None], pa.int64())})

        for batch in batches:
            for k, cells, lang, n in zip(batch.column("block").to_pylist(), batch.column("cells"), batch.column("lang").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if k < 0:
                    totals[lang] = totals.get(lang, 0) + n
                    continue
                if k != at:
                    yield from done()
                    at, sums = k, np.zeros(block, np.uint32)
                sums = np.minimum(sums + np.frombuffer(unpress(cells.as_py()), kind), np.uint32(1 << 30))
        yield from done()
        for lang, n in totals.items():
            yield pa.record_batch({"block": pa.array([-1], pa.int32()), "marks": pa.array([None], pa.binary()), "lang": pa.array([lang], pa.string()), "n": pa.array([n], pa.int64())})

    partial = docs.mapInArrow(count, "block int, cells binary, lang string, n long")
    return partial.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, marks binary, lang string, n long")


def survivors(docs: DataFrame, longest: int, bits: int, marks) -> DataFrame:
    """Rows (lang, phrase, words, n): counts, by task, of all phrases whose cells are marked, as are those of the phrases inside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows = _Words(), marks.value
        held: dict[tuple[str, bytes, int], int] = {}
        kept: list[pa.Table] = []

        def stowed() -> int:
            """Put the counts held with those kept, one row for a phrase; how many are kept."""
            columns = {"lang": pa.array([k[0] for k in held], pa.string()), "phrase": pa.array([k[1].decode() for k in held], pa.large_string()), "words": pa.array([k[2] for k in held], pa.int32()), "n": pa.array(list(held.values()), pa.int64())}
            held.clear()
            every = pa.concat_tables([*kept, pa.table(columns)])
            kept[:] = [every.group_by(["lang", "phrase", "words"], use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["lang", "phrase", "words", "n"])]
            return len(kept[0])

        def handed() -> Iterator[pa.RecordBatch]:
            stowed()
            table = kept.pop()
            yield from table.set_column(1, "phrase", table["phrase"].cast(pa.string())).to_batches(max_chunksize=1 << 16)

        for lang, at, hashes in _numbered(batches, words):
            spelled = list(words)
            places = np.flatnonzero(at)
            phrases = hashes[places]
            for n in range(1, longest + 1):
                for row in range(len(ROWS)):
                    cell = _cells(phrases, row, bits)
                    alive = np.flatnonzero(rows[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1)
                    places, phrases = places[alive], phrases[alive]
                _, first, which, counts = np.unique(phrases, return_index=True, return_inverse=True, return_counts=True)
                same = np.ones(len(places), bool)
                for j in range(n):
                    same &= at[places + j] == at[places[first][which] + j]
                numbers = [at[places[first] + j].tolist() for j in range(n)]
                if not same.all():  # phrases with equal hashes: the later ones count apart
                    counts = np.bincount(which[same], minlength=len(first))
                    others, more = np.unique(np.stack([at[places[~same] + j] for j in range(n)], axis=1), axis=0, return_counts=True)
                    numbers = [x + y for x, y in zip(numbers, others.T.tolist(), strict=True)]
                    counts = np.append(counts, more)
                for key, k in zip(zip(*numbers, strict=True), counts.tolist(), strict=True):
                    name = lang, b" ".join([spelled[x] for x in key]), n
                    held[name] = held.get(name, 0) + k
                if len(held) > HELD and stowed() > KEPT:
                    yield from handed()
                if n < longest:
                    alive = np.zeros(len(at) + 1, bool)
                    alive[places] = True
                    going = np.flatnonzero(alive[places + 1] & (places + n < len(at)))
                    going = going[at[places[going] + n] != 0]
                    places = places[going]
                    phrases = _longer(phrases[going], hashes, places + n)
        yield from handed()

    return docs.mapInArrow(run, "lang string, phrase string, words int, n long")


def frequent(docs: DataFrame, longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Tables (lang, phrase, words, n) of all phrases of up to `longest` words that occur `least` times in a language, with exact counts, and (lang, total) of its words.

    docs: (text, lang); see collocations().
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    rows = rows.coalesce(TASKS * spark.sparkContext.defaultParallelism)  # each task hands on a sketch and most frequent phrases, so that tasks don't grow in number with the texts
    phrases = longest * (rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) / 6
    bits = (min(MOST_CELLS, max(1 << 12, int(phrases / LOAD))) - 1).bit_length()
    merged = saved(sketch(rows, longest, least, bits), "sketch")
    found = {r.block: np.frombuffer(bytes(r.marks), np.uint8) for r in merged.where("block >= 0").collect()}
    marks = np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(len(ROWS) << bits >> 3, np.uint8)
    counted = survivors(rows, longest, bits, spark.sparkContext.broadcast(marks.reshape(len(ROWS), -1)))
    counts = saved(counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
    return counts, merged.where("block < 0").groupBy("lang").agg(F.sum("n").alias("total"))


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, explained: int = 100, top: int = 2000) -> DataFrame:
    """Each language's first `top` phrases: rows (lang, rank, phrase, a, l, r, n, score).

    docs: (text, lang); other columns are ignored. A-Z count as a-z; `.,;:!?` and line
    breaks end a piece, spaces and tabs a word, and phrases of 2 to `longest` words lie
    within a piece. a: occurrences, `least` or more; n: words of the language; a cut after
    k words has l and r occurrences of its parts and the score floor(1000 a n / (l r)); the
    weakest cut counts, the first of equal ones. A phrase is dropped if its words lie
    inside a longer candidate with `explained` per cent of its occurrences or more. Order:
    score, occurrences (largest first), phrase by its UTF-8 bytes.

    A null text is an empty one, a null lang is `und`; repeated rows count each; an empty
    table gives no rows; texts of any length are read whole. All counts are exact, the
    sketch only spares work: its two rows have at most MOST_CELLS cells, and with more than
    some 100 phrases for a cell it spares little. The driver sees a bit for each cell
    (8 MB at most). Texts are read by TASKS tasks a core, by Spark's default parallelism,
    since each hands on a sketch and counts of most frequent phrases.
    """
    counts, totals = frequent(docs, longest, least)
    whole = counts.where("words > 1").withColumnRenamed("n", "a")
    cuts = whole.select("lang", "phrase", "words", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals.withColumnRenamed("total", "n"), "lang")
    wide = lambda name: f"CAST({name} AS DECIMAL(17, 0))"  # noqa: E731  products of two have 35 digits at most
    score = F.expr(f"(CAST({wide('a')} * {wide('n')} AS DECIMAL(34, 0)) * CAST(1000 AS DECIMAL(4, 0))) div ({wide('l')} * {wide('r')})")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    inside = whole.where("words > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own = weakest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < explained * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases of all documents of the table."""
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def oracle(longest: int = 5, least: int = 100, top: int = 2000) -> str:
    """The same in plain SQL: all phrases are made and counted."""
    return f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents),
    worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
    placed AS (SELECT lang, w, s.size AS size, unnest(range(1, len(w) - s.size + 2)) AS pos FROM worded, range(1, {longest + 1}) s(size) WHERE len(w) >= s.size),
    counts AS (SELECT lang, array_to_string(w[pos : pos + size - 1], ' ') AS phrase, size, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= {least}),
    candidates AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
    cuts AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c JOIN totals t USING (lang)
        JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 : c.size], ' ')),
    weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_ AS (SELECT c.lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM candidates c, range(2, {longest}) p(m), range(1, {longest}) q(i) WHERE m < size AND i + m - 1 <= size GROUP BY ALL),
    own AS (SELECT k.* FROM weakest k LEFT JOIN inner_ i ON i.lang = k.lang AND i.phrase = k.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * k.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS "rank", phrase, a, l, r, n, score FROM own QUALIFY "rank" <= {top}"""
