"""License scans by a positional index of rare words, with column expressions only.

Templates are the opening sentences of common licenses and the short phrases that name
one. Function words are left out of the index, but still count as positions, and in a
mandatory phrase each must stand at its own. For each file the index takes, of every template, the template's words that the file holds and
that are rarest in the corpus; their postings give the places where the template would
have to begin. A place counts if enough of these words agree on it and the template's
mandatory phrases stand at their positions there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texspark.llm.common import saved, table

# Phrases that alone decide (label, phrase).
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
# License texts as (label, opening words, mandatory phrases in them).
TEXTS = [
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee is hereby granted"]),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "provided that the following conditions are met"]),
    ("apache-text", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["licensed under the apache license version 2 0", "except in compliance with the license"]),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["this program is free software", "under the terms of the gnu general public license"]),
    ("mpl-text", "this source code form is subject to the terms of the mozilla public license v 2 0", ["subject to the terms of the mozilla public license"]),
    ("unlicense-text", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("mit-notice", "released under the mit license", ["released under the mit license"]),
    ("apache-notice", "licensed under the apache license version 2 0", ["licensed under the apache license version 2 0"]),
]
# Function words, which are not indexed.
FUNCTION_WORDS = "a an and any are as be by can for from in into is it may not of on or out that the this to under use with without you your".split()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rarest words of a template that a file is looked up by.
LOOKUPS = 4


Placed = list[tuple[int, str]]


def templates(phrases: list[tuple[str, str]] = PHRASES, texts: list[tuple[str, str, list[str]]] = TEXTS) -> list[tuple[int, str, bool, Placed, Placed, Placed]]:
    """(number, label, is a phrase, indexed words with positions, those of them that must agree, function words that must)."""
    out = []
    for label, phrase in phrases:
        words = list(enumerate(phrase.split()))
        out.append((len(out), label, True, words, words, []))
    for label, text, must in texts:
        words = text.split()
        indexed = [(i, w) for i, w in enumerate(words) if w not in FUNCTION_WORDS]
        at = set()
        for phrase in must:
            want = phrase.split()
            begin = next(i for i in range(len(words)) if words[i : i + len(want)] == want)
            at.update(range(begin, begin + len(want)))
        out.append((len(out), label, False, indexed, [(i, w) for i, w in indexed if i in at], [(i, w) for i, w in enumerate(words) if i in at and w in FUNCTION_WORDS]))
    return out


def words_of(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, texts: list[tuple[str, str, list[str]]] = TEXTS) -> DataFrame:
    """Licenses of documents (doc_id, text): phrases (label, words) and texts (label, words, mandatory phrases in them).

    Returns a row for each row of docs: doc_id, n_words, places (an array of label,
    is_phrase, start, n_words, score; sorted by start), and licences' labels and score:
    base_labels, labels, score (the best place's share of its template's rarity; 1 for a
    phrase; 0 without a place). Null and empty texts have no words and no places; repeated
    rows are scanned once each; an empty table gives no rows; other columns are ignored. A
    text's words are held as one array, so a text must fit in a task.
    """
    spark = docs.sparkSession
    known = templates(phrases, texts)
    vocabulary = sorted({w for *_, indexed, _, _ in known for _, w in indexed})
    between = sorted({w for *_, small in known for _, w in small})
    indexed_words = F.array(*map(F.lit, vocabulary))

    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    of = lambda some: F.when(F.arrays_overlap("words", indexed_words), F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: x.word.isin(some)))
    hits = saved(words.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), of(vocabulary).alias("hits"), of(between).alias("between")), "licence-words")

    # Rarity over all documents, of at most len(vocabulary) words.
    total = hits.count()
    counted = {r.word: r.n for r in hits.where("hits is not null").select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    idf = {w: math.log((1 + total) / (1 + counted.get(w, 0))) + 1 for w in vocabulary}
    postings = spark.createDataFrame([(t, i, w, idf[w]) for t, *_, indexed, _, _ in known for i, w in indexed], "template int, at int, word string, idf double")
    about = spark.createDataFrame([(t, label, phrase, len(must), sum(idf[w] for _, w in indexed), max(len(indexed) // 2, 1) if not phrase else len(indexed), indexed[-1][0] + 1, small) for t, label, phrase, indexed, must, small in known], "template int, label string, is_phrase boolean, n_must int, weight double, n_least int, span int, small array<struct<at: int, word: string>>")
    required = spark.createDataFrame([(t, i, w) for t, *_, must, _ in known for i, w in must], "template int, at int, word string").withColumn("must", F.lit(1))

    # Look up each file's rarest words of each template: where they stand are the candidate places.
    seen = hits.where("hits is not null").select("row", F.explode("hits").alias("h")).select("row", "h.pos", "h.word")
    present = hits.where("hits is not null").select("row", F.explode(F.array_distinct("hits.word")).alias("word"))
    ranked = present.join(F.broadcast(postings.groupBy("template", "word").agg(F.first("idf").alias("idf"))), "word")
    rare = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("row", "template").orderBy(F.desc("idf"), "word"))).where(F.col("rank") <= LOOKUPS).select("row", "template", "word")
    starts = seen.join(rare, ["row", "word"]).join(F.broadcast(postings.select("template", "at", "word")), ["template", "word"]).select("row", "template", (F.col("pos") - F.col("at")).alias("start")).where("start >= 0").distinct()

    # Verify the template's words there, the mandatory ones among them.
    wanted = starts.join(F.broadcast(postings.join(F.broadcast(required), ["template", "at", "word"], "left")), "template").select("row", "template", "start", (F.col("start") + F.col("at")).alias("pos"), "word", "idf", "must")
    agreed = (
        wanted.join(seen, ["row", "pos", "word"]).groupBy("row", "template", "start").agg(F.sum("idf").alias("idf"), F.count("*").alias("n"), F.sum(F.coalesce("must", F.lit(0))).alias("musts"))
        .join(F.broadcast(about), "template").where("musts = n_must and n >= n_least")
    )
    # The few places that are left need the phrases' function words too.
    here = F.forall("small", lambda x: F.array_contains(F.col("between"), F.struct((F.col("start") + x.at).cast("int").alias("pos"), x.word.alias("word"))))
    places = (
        agreed.join(hits.select("row", "between"), "row").where(here)
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "label", "is_phrase", F.col("span").cast("long").alias("n_words"), F.least(F.lit(1.0), F.col("idf") / F.col("weight")).alias("score")))).alias("places"))
    )
    none = F.array().cast("array<struct<start:bigint,label:string,is_phrase:boolean,n_words:bigint,score:double>>")
    out = hits.select("row", "doc_id", "n_words").join(places, "row", "left").withColumn("places", F.coalesce("places", none))
    labels = lambda p: F.array_join(F.array_sort(F.array_distinct(F.transform(p, lambda x: x.label))), ",")
    return out.select("doc_id", "n_words", "places", labels(F.filter("places", lambda x: x.is_phrase)).alias("base_labels"), labels(F.col("places")).alias("labels"), F.round(F.coalesce(F.array_max(F.transform("places", lambda x: x.score)), F.lit(0.0)), 6).alias("score"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's license phrases and labels."""
    base = F.filter("places", lambda x: x.is_phrase)
    starts = F.transform(base, lambda x: x.start)
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), "base_labels", "labels", "score")


def oracle() -> str:
    """The columns and rows of op2_license_scan in DuckDB."""
    known = [(label, phrase, phrase.split(), [phrase]) for label, phrase in PHRASES] + [(label, "", text.split(), must) for label, text, must in TEXTS]
    indexed = [[i for i, w in enumerate(words) if phrase or w not in FUNCTION_WORDS] for _, phrase, words, _ in known]
    postings = ", ".join(f"({t}, {i}, '{known[t][2][i]}')" for t, some in enumerate(indexed) for i in some)
    about = ", ".join(f"({t}, '{label}', {str(bool(phrase)).lower()}, {len(indexed[t]) if phrase else max(len(indexed[t]) // 2, 1)})" for t, (label, phrase, *_) in enumerate(known))
    musts = ", ".join(f"({t}, {len(' '.join(words).split(must)[0].split())}, {len(must.split())}, '{must}')" for t, (*_, words, some) in enumerate(known) for must in some)
    return f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
posting(template, tpos, word) AS (VALUES {postings}),
about(template, label, is_phrase, n_least) AS (VALUES {about}),
phrase(template, begin, size, phrase) AS (VALUES {musts}),
seen AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM words),
idf AS (SELECT p.word, ln((1 + (SELECT count(*) FROM words)) / (1 + count(DISTINCT s.r))) + 1 AS idf FROM (SELECT DISTINCT word FROM posting) p LEFT JOIN seen s ON s.word = p.word GROUP BY p.word),
weight AS (SELECT template, sum(idf) AS weight FROM posting JOIN idf USING (word) GROUP BY template),
place AS (SELECT r, template, pos - tpos AS start, count(*) AS n, sum(idf) AS idf FROM seen JOIN posting USING (word) JOIN idf USING (word) WHERE pos >= tpos GROUP BY ALL),
hit AS (SELECT r, start, label, is_phrase, least(1.0, idf / weight) AS score FROM place JOIN about USING (template) JOIN weight USING (template) JOIN words USING (r)
  WHERE n >= n_least AND NOT EXISTS (SELECT 1 FROM phrase WHERE phrase.template = place.template AND array_to_string(w[start + begin + 1 : start + begin + size], ' ') <> phrase))
SELECT doc_id, len(w)::BIGINT AS n_words, count(start) FILTER (is_phrase)::BIGINT AS n_base, min(start) FILTER (is_phrase)::BIGINT AS first_word, max(start) FILTER (is_phrase)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_phrase), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, round(coalesce(max(score), 0.0), 6)::DOUBLE AS score
FROM words LEFT JOIN hit USING (r) GROUP BY words.r, doc_id, w"""
