import itertools
import math
import random

import numpy as np
import pytest

from texspark.operators import block_search, bptc, search
from texspark.operators.encode import BALANCED, WEIGHTS

KEYS = ["texture_id", "bx"]


def blocks():
    rng = random.Random(11)
    px = lambda top=256: tuple(rng.randrange(top) for _ in range(4))
    ramp = [(10 * t, 250 - 9 * t, 7 * t, 255) for t in range(16)]
    out = [[px() for _ in range(16)] for _ in range(30)] + [[px(4) for _ in range(16)] for _ in range(10)]
    out += [[(9, *px()[1:]) for _ in range(16)] for _ in range(5)] + [[px()] * 16, [(0, 0, 0, 0)] * 16, ramp, [ramp[t % 2] for t in range(16)], [(255, 0, 0, 9)] * 15 + [(0, 0, 255, 9)]]
    return out


def texels(spark, some):
    rows = [(k // 3, k % 3, t, *p, "clash") for k, block in enumerate(some) for t, p in enumerate(block)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "texture_id long, bx int, t int, r int, g int, b int, a int, px string").repartition(3)


def by_block(rows):
    return {r.texture_id * 3 + r.bx: r for r in rows}


@pytest.mark.parametrize("channels", ["rgba", "rgb"])
def test_farthest_pairs(spark, channels):
    got = by_block(block_search.farthest_pairs(texels(spark, blocks()), KEYS, channels).collect())
    for k, block in enumerate(blocks()):
        far = lambda ij: sum((x - y) ** 2 for x, y in list(zip(block[ij[0]], block[ij[1]], strict=True))[: len(channels)])  # noqa: B023, E731
        best = max(itertools.combinations(range(16), 2), key=lambda ij: (far(ij), -ij[0], -ij[1]))  # noqa: B023
        assert (got[k].i, got[k].j, got[k].distance) == (*best, far(best))


@pytest.mark.parametrize(("subsets", "limit", "partitions"), [(2, 5, 64), (3, 16, 16), (2, 64, 64), (3, 1, 64)])
def test_partition_ranks(spark, subsets, limit, partitions):
    got: dict = {}
    for r in block_search.partition_ranks(texels(spark, blocks()), KEYS, subsets, limit, partitions).orderBy("rank").collect():
        got.setdefault(r.texture_id * 3 + r.bx, []).append((r.part, r.score))
    for k, block in enumerate(blocks()):
        scores = []
        for part, places in enumerate(bptc.partitions(subsets)[0][:partitions].tolist()):
            own = [[block[t] for t in range(16) if places[t] == s] for s in range(subsets)]
            scores.append((sum((x[c] - sum(y[c] for y in some) // len(some)) ** 2 for some in own for x in some for c in range(4 if subsets == 2 else 3)), part))
        assert got[k] == [(part, score) for score, part in sorted(scores)[:limit]]


def test_partitions_have_two_or_three_subsets(spark):
    with pytest.raises(ValueError, match="two or three"):
        block_search.partition_ranks(texels(spark, blocks()), KEYS, 1)


def word(v):
    return (v[0] >> 3) << 11 | (v[1] >> 2) << 5 | v[2] >> 3


def test_principal_ends(spark):
    got = by_block(block_search.principal_ends(texels(spark, blocks()), KEYS).collect())
    for k, block in enumerate(blocks()):
        mean = [sum(p[c] for p in block) / 16 for c in range(3)]
        cov = [[sum((p[c] - mean[c]) * (p[d] - mean[d]) for p in block) for d in range(3)] for c in range(3)]
        axis = [1.0, 1.0, 1.0]
        dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
        for _ in range(8):
            v = [dot(row, axis) for row in cov]
            n = math.sqrt(dot(v, v))
            axis = axis if n < 1e-5 else [x / n for x in v]
        along = [dot(p, axis) for p in block]
        lo, hi = along.index(min(along)), along.index(max(along))
        drawn = [(block[hi][c] - block[lo][c]) >> 4 for c in range(3)]
        assert (got[k].lo_t, got[k].hi_t) == (lo, hi)
        assert (got[k].c0, got[k].c1) == (word([max(0, block[hi][c] - drawn[c]) for c in range(3)]), word([min(255, max(0, block[lo][c] + drawn[c])) for c in range(3)]))


def palette(c0, c1):
    wide = [[(v * 255 + top // 2) // top for v, top in zip((c >> 11, c >> 5 & 63, c & 31), (31, 63, 31), strict=True)] for c in (c0, c1)]
    mix = (lambda a, b: [(2 * a + b + 1) // 3, (a + 2 * b + 1) // 3]) if c0 > c1 else (lambda a, b: [(a + b) // 2, 0])
    return [*wide, *map(list, zip(*(mix(a, b) for a, b in zip(*wide, strict=True)), strict=True))]


def fitted(block, c0, c1, rounds):
    weights = BALANCED if len({p[0] for p in block}) == 1 else WEIGHTS
    c0, c1 = max(c0, c1), min(c0, c1)

    def choice(c0, c1):
        return [min((sum(w * (x - y) ** 2 for w, x, y in zip(weights, p, e, strict=False)), i) for i, e in enumerate(palette(c0, c1))) for p in block]

    error = sum(e for e, _ in choice(c0, c1))
    for _ in range(rounds):
        y = [(0, 3, 1, 2)[i] for _, i in choice(c0, c1)]
        x = [3 - v for v in y]
        xx, yy, xy = (sum(a * b for a, b in zip(*pair, strict=True)) for pair in ((x, x), (y, y), (x, y)))
        det = xx * yy - xy * xy
        if not error or not det:
            break
        near = lambda n: max(0, min(255, int(math.copysign((2 * abs(n) + det) // (2 * det), n))))  # noqa: B023, E731
        ends = [[], []]
        for c in range(3):
            xp, yp = (sum(s * p[c] for s, p in zip(side, block, strict=True)) for side in (x, y))
            ends[0].append(near(3 * (xp * yy - yp * xy)))
            ends[1].append(near(3 * (yp * xx - xp * xy)))
        new = sorted(map(word, ends), reverse=True)
        total = sum(e for e, _ in choice(*new))
        if new == [c0, c1] or total >= error:
            break
        (c0, c1), error = new, total
    return c0, c1, error


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_least_squares_ends(spark, rounds):
    rng = random.Random(rounds)
    seeds = [(rng.randrange(1 << 16), rng.randrange(1 << 16)) if k % 4 else (word(max(b)), word(min(b))) for k, b in enumerate(blocks())]
    seeds[3] = (seeds[3][0],) * 2
    ends = spark.createDataFrame([(k // 3, k % 3, *s) for k, s in enumerate(seeds)], "texture_id long, bx int, c0 int, c1 int")
    rows = block_search.gathered(texels(spark, blocks()), KEYS).join(ends, KEYS)
    out = block_search.least_squares_ends(rows, KEYS, rounds)
    assert "Python" not in out._jdf.queryExecution().toString()
    got = by_block(out.collect())
    assert {k: (r.c0, r.c1, r.error) for k, r in got.items()} == {k: fitted(b, *seeds[k], rounds) for k, b in enumerate(blocks())}
    if rounds == 3:
        assert any((r.c0, r.c1) != tuple(sorted(seeds[k], reverse=True)) for k, r in got.items())


@pytest.mark.parametrize("level", [2, 3, 5, 8])
def test_bc1_levels_are_those_of_the_codec(spark, level):
    some, wanted = blocks(), search.LEVELS[level]
    some += [[(*p[:3], a) for p, a in zip(b, [200] * 9 + [100] * 7, strict=True)] for b in some[:12]]
    out = block_search.encode_bc1(texels(spark, some), KEYS, wanted.axis, wanted.tries if level < 8 else 40, wanted.step, wanted.rounds)
    assert "Python" not in out._jdf.queryExecution().toString()
    got = by_block(out.collect())
    array = np.array(some, dtype=np.uint8)
    want = search.encode_array(array, "BC1", wanted if level < 8 else search.Level(wanted.axis, 40, wanted.step, 0, wanted.rounds))
    assert [bytes(got[k].block) for k in range(len(some))] == [bytes(b) for b in want]


def test_an_empty_table_has_no_blocks(spark):
    none = texels(spark, blocks()).where("t > 99")
    assert not block_search.farthest_pairs(none, KEYS).collect() and not block_search.principal_ends(none, KEYS).collect() and not block_search.partition_ranks(none, KEYS).collect()
