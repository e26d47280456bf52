import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from texspark.functions import bits128
from texspark.operators import bptc, bptc_plans, decode


def blocks(seed, firsts):
    rng = random.Random(seed)
    return [bytes([rng.choice(firsts)]) + rng.randbytes(15) for _ in range(700)] + [bytes(16), b"\xff" * 16, bytes(15) + b"\x80"]


def decoded(spark, name, some):
    rows = [(i, b, "clash", 1) for i, b in enumerate(some)] + [(-1, None, "clash", 1)]
    out = decode.decode_blocks(spark.createDataFrame(rows, "mode int, block binary, lo string, part int"), name)
    assert "Python" not in (plan := out._jdf.queryExecution().toString()) and "Arrow" not in plan and "Exchange hash" not in plan
    channels = out.columns[4:]
    got = np.zeros((len(some), 16, len(channels)), np.int64)
    found = out.collect()
    assert len(found) == 16 * len(some) and out.columns[:4] == ["mode", "lo", "part", "t"]
    for r in found:
        got[r.mode, r.t] = tuple(r)[4:]
    return got


def test_bc7_blocks_are_those_of_the_codec(spark):
    some = blocks(3, [0, *(1 << m for m in range(8)), *(3 << m for m in range(7))])
    want = bptc.decode_bc7(np.frombuffer(b"".join(some), np.uint8).reshape(-1, 16))
    assert (decoded(spark, "BC7", some) == want).all()


@pytest.mark.parametrize("name", ["BC6HU", "BC6HS"])
def test_bc6h_blocks_are_those_of_the_codec(spark, name):
    some = blocks(4, range(256))
    want = bptc.decode_bc6h(np.frombuffer(b"".join(some), np.uint8).reshape(-1, 16), name == "BC6HS")
    assert (decoded(spark, name, some) == want).all()


def test_layouts_are_small(spark):
    assert bptc_plans.bc7_layout(spark).count() == 16 + 4 * 64 + 3 + 1 and bptc_plans.bc6h_layout(spark).count() == 10 * 32 + 4 + 4


def test_fields_lie_anywhere_in_128_bits(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        size = rng.randrange(0, 33)
        rows.append((rng.randbytes(16), rng.randrange(129 - size), size, rng.getrandbits(40)))
    rows += [(b"\xff" * 16, at, size, -1) for at, size in ((0, 0), (0, 1), (63, 1), (63, 2), (64, 1), (64, 62), (60, 62), (0, 62), (127, 1))]
    lo, hi = bits128.halves(F.col("block"))
    low, high = bits128.put("value", "at", "size")
    df = spark.createDataFrame(rows, "block binary, at int, size int, value long").withColumns({"lo": lo, "hi": hi})
    df = df.selectExpr("*", f"{bits128.read('at', 'size')} AS found", f"{low} AS w_lo", f"{high} AS w_hi").withColumn("word", bits128.to_block(F.col("w_lo"), F.col("w_hi"))).withColumn("again", bits128.to_block(F.col("lo"), F.col("hi")))
    for r in df.collect():
        mask = (1 << r.size) - 1
        assert r.found == int.from_bytes(r.block, "little") >> r.at & mask
        assert int.from_bytes(r.word, "little") == (r.value & mask) << r.at and bytes(r.again) == bytes(r.block)
    for at, size in ((0, 5), (60, 8), (64, 3), (100, 28)):
        got = df.selectExpr("block", f"{bits128.read(at, size)} AS v", *(f"{x} AS {n}" for n, x in zip(("x_lo", "x_hi"), bits128.written([("lo", at, size)]), strict=True))).withColumn("word", bits128.to_block(F.col("x_lo"), F.col("x_hi"))).limit(50).collect()
        for r in got:
            whole = int.from_bytes(r.block, "little")
            assert r.v == whole >> at & ((1 << size) - 1) and int.from_bytes(r.word, "little") == (whole & ((1 << size) - 1)) << at
