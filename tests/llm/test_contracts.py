"""The registered queries on small tables with nulls, empty texts and repeated rows: columns, types and rows."""

import zlib

import pytest

from texspark.llm import registry

COLUMNS = {
    "op1_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op5_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op13_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
}
TEXT = "Some words of a text under the MIT License with token = abcdef0123456789abcdef in it"
DOCS = [(i, f"{TEXT} number {i} {'<|endoftext|>' if i % 5 == 0 else 'x'}", "en", f"s{i % 3}", 1) for i in range(40)] + [(40, None, None, None, None), (41, "", "de", "s1", 0), (None, "no id", None, "s1", 5), (7, TEXT, "en", None, 9), (7, TEXT, "en", None, 9)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    rows = {
        "documents": ("doc_id long, text string, lang string, source string, n_chars long", DOCS),
        "labels": ("doc_id long, quality int, toxic int", [(i, i % 2, int(i % 7 == 0)) for i in range(38)] + [(None, 1, 1), (39, None, None)]),
        "pages": ("page_id long, url string, html string", [(i, f"http://x/{i}", f"<p>{i % 6}</p>" if i % 4 else None) for i in range(20)]),
        "embeddings": ("vec_id long, embedding array<float>", [(i, [float(i % 7), -0.5, i / 100]) for i in range(120)] + [(None, [1.0, 1.0, 1.0]), (500, None), (550, [float("nan"), 1.0, 1.0]), (600, [None, 1.0, 1.0])]),
    }
    for name, (schema, some) in rows.items():
        spark.createDataFrame(some, schema).write.parquet(f"{full}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    return str(full), str(empty)


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, tables, name):
    query = registry.queries()[name]
    out = query(spark, tables[0])
    want = COLUMNS[name].split(", ")
    assert [f"{f.name} {f.dataType.simpleString()}" for f in out.schema][: len(want)] == want
    rows = out.collect()
    if name == "op1_packing":
        assert {r.doc_id for r in rows} == {d[0] for d in DOCS} and all(0 <= r.ids_crc32 < 1 << 32 for r in rows)
        assert sum(r.length for r in rows if r.start == 0 and r.doc_id == 40) == 1 and [r.ids_crc32 for r in rows if r.doc_id == 40] == [zlib.crc32(bytes(4))]
    elif name == "op4_top_k":
        assert len(rows) == 3 * 5 and {r.query_id for r in rows} == {0, 50, 100}
    elif name == "op11_collocations":
        assert rows == []  # no phrase occurs 100 times
    elif name == "op6_warc":
        assert sorted(r.page_id for r in rows) == list(range(20)) and {r.record_type for r in rows} == {"response", "revisit"}
    else:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(d[0]) for d in DOCS)
    if name in ("op3_language_id", "op10_toxicity"):
        n = 4 if name == "op3_language_id" else 5
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == (2 if n == 4 else 0)) for r in rows if r.doc_id is not None)
    assert query(spark, tables[1]).collect() == []
