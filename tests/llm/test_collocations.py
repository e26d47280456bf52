import random
import re
from collections import Counter

import duckdb
import pytest

from texspark.llm import collocations


def plain(rows, longest, least, explained, top):
    """The contract's words, in dictionaries."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    out = []
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in candidates.items():
        longer = (b for (x, v), b in candidates.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))))
        if any(100 * b >= explained * a for b in longer):
            continue
        score, k = min((1000 * a * totals[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]], totals[lang]))
    ranked, rank = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return ranked


def rows_of(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "city", "é", "中", "a-b", "#", "'", "\xa0", "x\x1cy", "\x00"]
    text = lambda: "".join(rng.choice(words + ["new york city hall now"]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", ";"]) for _ in range(rng.randrange(40)))
    return [(text(), rng.choice(["en", "en", "en", "de", None, "und"])) for _ in range(150)] + [(None, "en"), ("", None), ("one", "fr"), ("  ..  ", "fr")] + [("copy of the text", "en")] * 40


@pytest.mark.parametrize(("least", "longest", "explained", "top"), [(8, 5, 100, 2000), (3, 4, 80, 7), (300, 5, 100, 5), (1, 3, 100, 50)])
def test_rows_are_those_of_the_plain_version(spark, least, longest, explained, top):
    rows = rows_of(least)
    docs = spark.createDataFrame([(t, lang, 1, "clash") for t, lang in rows], "text string, lang string, n long, phrase string").repartition(5)
    got = collocations.collocations(docs, longest, least, explained, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, longest, least, explained, top))


def test_a_crowded_sketch_changes_no_count(spark, monkeypatch):
    rows = rows_of(77)
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(collocations, "MOST_CELLS", 16)
    assert sorted(map(tuple, collocations.collocations(docs, 5, 5, 100, 100).collect())) == sorted(plain(rows, 5, 5, 100, 100))


def test_sql_gives_the_same_rows(spark, tmp_path):
    rows = [r for r in rows_of(5) if "\x00" not in (r[0] or "")]
    spark.createDataFrame(rows, "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(collocations.oracle(5, 8)).fetchall()) == sorted(plain(rows, 5, 8, 100, 2000))


def test_large_counts_are_exact(spark, monkeypatch):
    counts = spark.createDataFrame([("en", "a b", 2, 9 * 10**15), ("en", "a", 1, 9 * 10**15 + 1), ("en", "b", 1, 10**16)], "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("en", 8 * 10**16)], "lang string, total long")
    monkeypatch.setattr(collocations, "frequent", lambda *a: (counts, totals))
    (row,) = collocations.collocations(None).collect()
    assert row.score == 1000 * 9 * 10**15 * 8 * 10**16 // ((9 * 10**15 + 1) * 10**16)


def test_phrases_with_equal_hashes_count_apart(monkeypatch):
    import pyarrow as pa

    class Marks:
        value = [__import__("numpy").full(1 << 9, 255, "uint8")] * 2

    monkeypatch.setattr(collocations, "_longer", lambda phrases, hashes, at: phrases * 0)
    caught = {}

    class Docs:
        def mapInArrow(self, run, schema):
            caught["run"] = run

    collocations.survivors(Docs(), 2, 12, Marks)
    (out,) = caught["run"](iter([pa.record_batch({"text": ["a b a b c a"], "lang": ["en"]})]))
    assert {r["phrase"]: r["n"] for r in out.to_pylist()} == {"a": 3, "b": 2, "c": 1, "a b": 2, "b a": 1, "b c": 1, "c a": 1}


def test_an_empty_table_has_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_partial_counts_do_not_grow_with_the_tasks(spark, monkeypatch):
    """Twenty times the texts in twenty times the partitions: the second pass hands on no more rows than its bounded tasks hold phrases."""
    rows, made = [("new york city hall", "en")] * 400, []
    survivors = collocations.survivors
    monkeypatch.setattr(collocations, "survivors", lambda *a: made.append(survivors(*a).localCheckpoint()) or made[-1])
    for parts in (10, 200):
        collocations.frequent(spark.createDataFrame(rows, "text string, lang string").repartition(parts), 5, 100)
    tasks = collocations.TASKS * spark.sparkContext.defaultParallelism
    assert [m.count() <= 10 * tasks for m in made] == [True, True]


def test_counts_that_tasks_stow_and_hand_on_are_exact(spark, monkeypatch):
    rows = rows_of(31)
    docs = spark.createDataFrame(rows, "text string, lang string")
    for name, value in (("HELD", 5), ("KEPT", 40), ("TOGETHER", 200)):
        monkeypatch.setattr(collocations, name, value)
    assert sorted(map(tuple, collocations.collocations(docs, 5, 5, 100, 100).collect())) == sorted(plain(rows, 5, 5, 100, 100))
