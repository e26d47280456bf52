import random
import zlib
from collections import Counter

import public_tokenizers as P
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(7)
    words = "the cat and dog were sitting with that thing over there while they thought of this one day in june".split()
    base = [" ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(rng.randrange(30, 90))) for _ in range(60)]
    base = [t.translate(str.maketrans("0123456789", "abcdefghij")) for t in base]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None) for i, t in enumerate(base)]
    rows += [(100 + i, t + (" extra" if i % 2 else ""), "en", "s0") for i, t in enumerate(base[:10])]  # copies and near copies
    secret = 'token = "fc22f42429fef2ebde85e081b172bc127a2eef28"'
    rows += [(200, base[20][:40] + " completely different text for this one " + secret, "en", "s1"), (201, None, "en", "s1"), (202, "12 34 !!", None, "s2"), (203, "", "en", None), (3, rows[3][1], "en", rows[3][3])]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    kept = docs
    stages = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, kept, str(tmp_path)).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == corpus_pipeline.COLUMNS
        stages[name] = [tuple(r) for r in kept.collect()]
    ids = lambda name: sorted(r[0] for r in stages[name])
    assert ids("language_id") == sorted(r[0] for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert ids("near_duplicates") == [*range(60), 200]
    assert ids("secrets") == ids("near_duplicates")
    (marked,) = [r for r in stages["secrets"] if r[0] == 200]
    assert marked[1].endswith('this one [SECRET]"') and marked[4] == len(marked[1])
    assert {r for r in stages["secrets"] if r[0] != 200} == {r for r in stages["near_duplicates"] if r[0] != 200}
    assert max(Counter(ids("mixing")).values()) <= 3 and set(stages["mixing"]) <= set(stages["secrets"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter(r[0] for r in stages["mixing"] for _ in range(1 + len(tk.encode(r[1], add_special_tokens=False).ids)))
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == want


def test_stages_on_empty_tables_null_ids_and_repeated_rows(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    assert [stage(spark, empty, "").count() for _, stage in corpus_pipeline.STAGES] == [0] * 5
    text = "a longer text of some words that has a near copy with one more word at its end"
    rows = [(None, text, None, None, None), (None, text, None, None, None), (None, text + " here", None, "s", 1), (5, text, "en", "s", 2), (5, "another text that shares the id of the copy of the longer text", "en", "s", 2), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.near_duplicate(spark, docs, "").collect()
    texts = sorted(str(r.text) for r in kept)
    assert len(kept) == 3 and texts[0] == "None" and texts[1].startswith(text) and texts[2] == rows[4][1]
    assert [r.doc_id for r in corpus_pipeline.secrets(spark, docs, "").collect()].count(None) == 4
    assert corpus_pipeline.language(spark, docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null"), "").count() >= 1


def test_run_reads_the_documents_table(spark, tmp_path):
    rows = [(i, f"some words of a text about number {'abcdefgh'[i]} and what it does", "en", "s", 1) for i in range(8)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = __spark_entry__.queries()["pipeline"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(range(8)) and all(0 <= r.ids_crc32 < 1 << 32 for r in out) and zlib.crc32(b"") == 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
