import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from texspark.llm import near_duplicates
from texspark.llm.components import components

DOCS = "doc_id long, text string, fp string, gid int, n string"


def shingles(text):
    words = bytes((text or "").encode()).lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(t) for _, t, *_ in rows]
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        least[find(i)] = min(x for x in (least.get(find(i)), d) if x is not None) if (least.get(find(i)), d) != (None, None) else None
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, *_) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(40))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy) + (f"\n{passage}" if rng.random() < 0.3 else ""))
    cluster = [word() for _ in range(120)]
    for _ in range(60):
        copy = list(cluster)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(len(copy))] = word()
        rows.append("\t".join(copy).upper())
    rows += ["", None, " \n", "one", "ONE", "one two", rows[0], "É é É É É", "é é é é é", "x " * 30_000]
    rng.shuffle(rows)
    return [(i * 3 % 1009 - 5, t, "f", 1, "n") for i, t in enumerate(rows)]


@pytest.mark.parametrize(("group", "leaders", "bands"), [(512, 8, 4), (4, 1, 1)])
def test_links_as_by_brute_force(spark, monkeypatch, group, leaders, bands):
    """Small cells and few leaders leave components that only the second round joins up."""
    for name, value in (("GROUP", group), ("LEADERS", leaders), ("BANDS", bands), ("_BAND_AT", near_duplicates._BAND_AT[:bands]), ("SEEN", group)):
        monkeypatch.setattr(near_duplicates, name, value)
    rows = corpus(group)
    rows += [rows[7], (None, "no id here at all in this text", "", 0, ""), (None, None, "", 0, "")]
    out = near_duplicates.similar(spark.createDataFrame(rows, DOCS).repartition(5))
    out = out.collect()
    assert sorted((tuple(r)[:3] for r in out), key=str) == brute(rows)
    leading = [(r.component_id, r.doc_id, r.key) for r in out if r.leads and r.n_shingles]
    assert {r.component_id for r in out if r.n_shingles} == {x[0] for x in leading}
    assert len(set(leading)) == len({x[0] for x in leading})


@pytest.mark.parametrize("percent", [50])
def test_other_thresholds(spark, percent):
    rows = [(i, t) for i, t in enumerate(["a b", "a b c", "b a", "a b", "a b c d", "a b c d e", "a b c d e f", "q a b c d e", "x y", "x y z w v u t s r", "x y z w v u t s"])]
    got = {r.doc_id: r.component_id for r in near_duplicates.similar(spark.createDataFrame(rows, "doc_id long, text string"), size=2, percent=percent).collect()}
    pairs = {i: {tuple(w[k : k + 2]) for k in range(len(w) - 1)} for i, t in rows if (w := t.split())}
    least = {i: i for i in pairs}
    for _ in pairs:
        for i, j in combinations(pairs, 2):
            both = len(pairs[i] & pairs[j])
            if both and 100 * both >= percent * len(pairs[i] | pairs[j]):
                least[i] = least[j] = min(least[i], least[j])
    assert got == least


def test_a_cluster_of_thousands_and_null_ids(spark, monkeypatch):
    """One cluster of near copies over many cells, whose ids are null for the most part."""
    monkeypatch.setattr(near_duplicates, "GROUP", 64)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(3000):
        copy = list(base)
        copy[rng.randrange(80)] = f"x{i}"
        texts.append(" ".join(copy))
    rows = [(None if i % 3 else i + 5, t) for i, t in enumerate(texts)] + [(9000 + i, f"other {i} text of six words") for i in range(30)]
    out = near_duplicates.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.component_id for r in out if r.doc_id is None or r.doc_id < 9000} == {5}
    assert all(r.component_id == r.doc_id for r in out if r.doc_id and r.doc_id >= 9000)
    assert sum(r.leads for r in out) == 31


def test_lookup_keeps_all_keys_and_few_others(spark):
    rows = spark.range(20_000)
    kept = {r.id for r in near_duplicates.among(rows, F.col("id"), spark.range(0, 20_000, 97)).collect()}
    assert kept >= set(range(0, 20_000, 97))
    assert len(kept) < 300


def test_empty_table(spark):
    assert near_duplicates.similar(spark.createDataFrame([], DOCS)).collect() == []


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_common_tokens_change_the_work_but_not_the_links():
    import numpy as np

    tokens = np.arange(1, 11, dtype=np.uint64)
    first = near_duplicates.in_order(tokens, 4, np.array([1, 2, 3, 4, 5, 6, 7, 8], dtype=np.uint64), np.array([9, 9, 9, 9, 9, 9, 5, 9]))
    assert [part.tolist() for part in first] == [[9, 10], [7, 1]]


def test_the_bitmaps_bound_never_closes_a_group_with_a_link():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 3000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:n], rng.integers(0, 1 << 62, extra, dtype=np.uint64)])) for n in (30, 400, 2900) for extra in (0, n // 9, n // 5, n)]
    bits = [(len(s), near_duplicates.bitmap(s)) for s in sets]
    for i, j in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            assert all(k.all() for k in near_duplicates.may_link([bits[i]], [bits[j]], 80))
            assert near_duplicates.may_link(bits, None, 80)[0][[i, j]].all()
    assert not near_duplicates.may_link([bits[3]], [bits[0]], 80)[1].any()


def test_common_tokens_are_known_however_documents_are_dealt(spark):
    """A passage that each task meets once or twice must not bring its documents together: 40 of 60 words are shared, no two texts link."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([f"w{rng.randrange(10**9)}" for _ in range(20)] + passage)) for i in range(160)]
    pairs = []
    for parts in (1, 160):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        docs = docs.select(F.col("doc_id").alias("did"), F.xxhash64("text").alias("key"), "doc_id", "text")
        matrix = near_duplicates.matrix_of(near_duplicates.described(docs, 5, 80))
        pairs.append(matrix.groupBy("token").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0] or 0)
    assert pairs[0] == pairs[1] <= len(rows)


def test_counts_of_tokens_are_those_of_a_plain_count(spark):
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    rows = corpus(9)
    sets = [s for s in near_duplicates.shingle_sets(pa.array([t for _, t, *_ in rows]), 5) if len(s) >= 4]
    tokens = Counter(int(t) >> 24 for s in sets for t in s)
    bands = Counter(int(b) >> 24 for s in sets for b in near_duplicates.bands_of(s))
    levels, popular, n = near_duplicates.frequent(spark.createDataFrame(rows, DOCS).repartition(23), 5, 80)
    assert dict(zip(popular.tolist(), n.tolist(), strict=True)) == {b: n for b, n in bands.items() if n >= 2}
    want = {}
    for t, k in tokens.items():
        if k >= 4:
            want[t >> 16] = max(want.get(t >> 16, 0), int(8 * np.log2(k)))
    assert len(levels) == 1 << 24
    assert {i: int(levels[i]) for i in np.flatnonzero(levels).tolist()} == want
