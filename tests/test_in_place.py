"""Queries over blocks of the orders: blocks are made where their order is, and stay there."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from texspark.functions.expressions import to_bytes
from texspark.operators import bc6h, block_search, bptc, decode, metrics, search, surfaces
from texspark.plans import queries
from texspark.sources import containers

KEYS = ["texture_id", "bx", "by"]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("orders"))
    rows = spark.range(300).selectExpr("id * 37 + 5 AS o_orderkey", "(id * 7919) % 1500 AS o_custkey")
    rows.union(spark.createDataFrame([(None, 3)], "o_orderkey long, o_custkey long")).write.parquet(f"{folder}/orders.parquet")
    return folder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_psnr_joins_nothing(spark, orders):
    out = queries.queries()["psnr_bc1"](spark, orders)
    assert "Join" not in plan(out)
    texels = queries._texels(spark, orders).where("texture_id IS NOT NULL")
    blocks = search.encode_texels(texels, "BC1", 1).selectExpr("texture_id", "explode(array(0, 1)) AS bx", "substring(payload, bx * 8 + 1, 8) AS block")
    again = decode.decode_blocks(blocks, "BC1").selectExpr("texture_id", "bx * 4 + t % 4 AS x", "t div 4 AS y", "r", "g", "b").withColumn("group", F.col("texture_id") % 10)
    want = metrics.psnr(texels.withColumn("group", F.col("texture_id") % 10), again, ["group"], ["texture_id", "x", "y"])
    assert {r.group: r.psnr for r in out.collect()} == {r.group: pytest.approx(r.psnr, abs=1e-4) for r in want.collect()}


@pytest.mark.parametrize("sizes", [[(8, 4)] * 9, [(5, 3)] * 4, [(5, 3), (8, 4), None, (1, 1), (5, 3)]])
def test_surfaces_of_one_size_are_encoded_like_others(spark, sizes):
    rng = np.random.default_rng(3)
    images = [None if s is None else rng.integers(0, 256, (s[1], s[0], 4), dtype=np.uint8) for s in sizes]
    rows = [(k, *((8, 4) if s is None else s), None if s is None else bytearray(i.tobytes())) for k, (s, i) in enumerate(zip(sizes, images, strict=True))]
    found = search.encode_surfaces(spark.createDataFrame(rows, "id int, width int, height int, rgba binary").coalesce(1), "BC3", 2).collect()
    want = [None if i is None else search.encode_array(search.blocks_of(i.tobytes(), i.shape[1], i.shape[0]), "BC3", 2).tobytes() for i in images]
    assert {r.id: r.payload and bytes(r.payload) for r in found} == dict(enumerate(want))



@pytest.mark.parametrize(("name", "subsets", "limit", "partitions"), [("partition_rank2", 2, 8, 64), ("partition_rank3", 3, 4, 16)])
def test_partitions_are_ranked_without_a_shuffle(spark, orders, name, subsets, limit, partitions):
    out = queries.queries()[name](spark, orders)
    assert "Exchange" not in plan(out)
    want = block_search.partition_ranks(queries._cells(spark, orders).where("texture_id IS NOT NULL"), KEYS, subsets, limit, partitions)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_ranks_of_large_and_missing_values(spark):
    rng = np.random.default_rng(5)
    some = rng.integers(-(1 << 24), 1 << 24, (3, 16, 4))
    texels = [(k, t, *(int(x) for x in p)) for k, block in enumerate(some) for t, p in enumerate(block)] + [(3, t, 1, None if t == 9 else 2, 3, 4) for t in range(16)]
    rows = spark.createDataFrame(texels, "id int, t int, r int, g int, b int, a int")
    got = {}
    for r in block_search.partition_ranks(rows, ["id"], 2, 3, 64).orderBy("rank").collect():
        got.setdefault(r.id, []).append((r.part, r.score))
    cut = lambda total, n: -(-total // n) if total < 0 else total // n
    for k, block in enumerate(some.tolist()):
        scores = []
        for part, places in enumerate(bptc.partitions(2)[0].tolist()):
            own = [[p for p, s in zip(block, places, strict=True) if s == half] for half in (0, 1)]
            scores.append((sum((p[c] - cut(sum(q[c] for q in half), len(half))) ** 2 for half in own for p in half for c in range(4)), part))
        assert got[k] == [(part, score) for score, part in sorted(scores)[:3]]
    assert got[3] == [(0, None), (1, None), (2, None)]
    assert not block_search.partition_ranks(rows, ["id"], 2, 0).collect()


@pytest.mark.parametrize("channels", ["rgb", "rgba"])
def test_farthest_texels_are_found_without_a_shuffle(spark, orders, channels):
    out = queries.queries()[f"farthest_{channels}"](spark, orders)
    assert "Exchange" not in plan(out)
    want = block_search.farthest_pairs(queries._cells(spark, orders).where("texture_id IS NOT NULL"), KEYS, channels)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_farthest_texels_of_a_block_that_lacks_a_value(spark):
    rows = spark.createDataFrame([(0, bytearray(range(64))), (1, None)], "id int, rgba binary")
    assert sorted(map(tuple, block_search.farthest_in_blocks(rows, ["id"]).collect())) == [(0, 0, 15, 4 * 60 * 60), (1, 0, 1, None)]


def test_bc1_blocks_are_planned_in_their_own_rows(spark, orders):
    out = queries.queries()["plan_bc1_level2"](spark, orders)
    text = plan(out)
    assert "Python" not in text and "Aggregate" not in text and "Join" not in text and text.count("Exchange") == 1 and "Exchange hashpartitioning(k#" in text
    want = block_search.encode_bc1(queries._cells(spark, orders).where("texture_id IS NOT NULL"), KEYS).select(*KEYS, F.hex("block"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["search_bc3_level6", "search_bc6h_level2"])
def test_surfaces_are_searched_where_they_are(spark, orders, name):
    out = queries.queries()[name](spark, orders)
    text = plan(out)
    assert "Aggregate" not in text and text.count("Exchange") == 1 and "Exchange hashpartitioning(k#" in text
    texels = queries._texels(spark, orders).where("texture_id IS NOT NULL")
    if "bc3" in name:
        want = search.encode_texels(texels, "BC3", 6)
    else:
        words = F.concat(*(to_bytes(F.expr(f"CAST({c} AS BIGINT) * 64"), 2) for c in "rgb"))
        want = surfaces.encoded_by_block(surfaces.block_rasters(texels, "rgb16", words), lambda blocks: bc6h.encode_hdr_surfaces(blocks, signed=False, level=2))
    assert {r.texture_id: r.digest for r in out.collect()} == {r.texture_id: r.d for r in want.select("texture_id", F.sha2("payload", 256).alias("d")).collect()}


def test_errors_of_a_batch_and_of_some_of_its_blocks_agree():
    rng = np.random.default_rng(9)
    some = rng.integers(0, 256, (40, 16, 4), dtype=np.uint8)
    colors = search.Colors(some, 128)
    c0, c1 = colors.ordered(*rng.integers(0, 1 << 16, (2, 40)))
    palette = search.color_palette(c0, c1)
    error = ((colors.rgb[:, :, None, :] - palette[:, None]) ** 2 * colors.weights[:, None, None, :]).sum(axis=3)
    error[colors.clear, :, 3] = 1 << 40
    want = np.where(colors.below, 0, error.min(axis=2)).sum(axis=1)
    rows = np.array([3, 4, 17, 39])
    assert (colors.total(c0, c1) == want).all() and (colors.total(c0[rows], c1[rows], rows) == want[rows]).all()
    assert (colors.nearest(c0, c1) == error.argmin(axis=2)).all()


@pytest.mark.parametrize("kind", ["dds", "ktx"])
def test_files_of_one_task_are_handed_on_together(spark, kind):
    rng = np.random.default_rng(2)
    data = [bytes(rng.integers(0, 256, 64, dtype=np.uint8)) for _ in range(40)]
    rows = [(k, "RGBA8", 0, 0, 4, 4, bytearray(d)) for k, d in enumerate(data)]
    files = containers.build_files(spark.createDataFrame(rows, "texture_id int, format string, face int, mip int, width int, height int, payload binary"), kind).coalesce(1)
    broken = files.selectExpr("CAST(texture_id AS STRING) AS path", "CASE WHEN texture_id % 7 = 3 THEN substring(content, 1, 70) ELSE content END AS content")
    found = {r.path: r for r in containers.parse_files(broken).collect()}
    assert len(found) == 40 and all((r.error is not None) == (int(p) % 7 == 3) for p, r in found.items())
    assert all(bytes(r.payload) == data[int(p)] and (r.format, r.face, r.n_mips) == ("RGBA8", 0, 1) for p, r in found.items() if not r.error)
    head = bytes(files.first().content)[:148]
    assert containers._layout(kind, head)[0] is containers._layout(kind, head)[0]  # equal headers are read once


def test_nearest_bc6h_entries_and_distant_texels():
    rng = np.random.default_rng(4)
    for top in (1 << 16, 1 << 40):  # 32-bit and 64-bit arithmetic
        v, e0, e1 = rng.integers(-top, top, (30, 16, 3)), *rng.integers(-top, top, (2, 30, 3))
        weight = bptc.WEIGHTS[3][:, None]
        palette = (e0[:, None, :] * (64 - weight) + e1[:, None, :] * weight + 32) >> 6
        assert (bc6h.nearest(v, e0, e1, 3) == np.abs(v[:, :, None] - palette[:, None]).sum(axis=3).argmin(axis=2)).all()
    v = rng.integers(0, 4, (30, 16, 3))
    inside = rng.integers(0, 4, (30, 16)) > 1
    inside[0] = np.arange(16) == 5
    for found, block, own in zip(bc6h.distant(v, inside, bc6h.distances(v)), v, inside, strict=True):
        pairs = [(i, j) for i in range(16) for j in range(i + 1, 16) if own[i] and own[j]] or [(own.argmax(),) * 2]
        i, j = max(pairs, key=lambda p: ((block[p[0]] - block[p[1]]) ** 2).sum())
        assert (found == [block[i], block[j]]).all()
