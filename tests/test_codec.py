import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from texspark.formats import FORMATS, format_of, level_size, mip_count
from texspark.functions import halves
from texspark.functions.expressions import apply
from texspark.functions.pixels import UNPACK
from texspark.operators import bc6h, bptc, decode, encode, metrics, mips, search, surfaces
import fixtures

# SHA-256 of the decoded blocks of fixtures.generated_blocks.
DECODED = {
    "BC1": "b3e4d9549f32b88ff0b00dad06d1f79f91f4bfedc42a51a0cccf96a73febb787",
    "BC2": "62e247a94003562eb1acc3a77698c0a37045de62dcc7d9f8bf00835c18626364",
    "BC3": "a536dca3657ec0eb9f452617b17fd468452e79157e5e89e46d6dc017a4fadf97",
    "BC4": "3af4486abc2fb5f76cf0b1f04042509e7903624d3a3bb0920a7f331d99921ba1",
    "BC5": "10506f5ce2923d2ae7347095785eea143a53c19c2aedb6841f9f0fc183443e91",
    "BC7": "7aa54064f8dab017e054610ce826bb66437059b24f1708ddb0740972aaecc07f",
}
# First eight bytes of SHA-256 of the 64x64 images encoded at the fastest level, then decoded.
ENCODED = {
    ("BC1", "opaque"): "645bebcb02564fba",
    ("BC1", "translucent"): "0f2d56329e5adbaa",
    ("BC2", "translucent"): "b0b375a13743fd27",
    ("BC3", "translucent"): "c2af7a143698e692",
    ("BC3", "nohq"): "8b732676827b3617",
    ("BC4", "opaque"): "b63e66185a881fd6",
    ("BC5", "opaque"): "51bfd7a4de1a48c9",
    ("BC4S", "opaque"): "0a1fcccb8b9c1fa5",
    ("BC5S", "opaque"): "0c714ffcf6660503",
}


@pytest.mark.parametrize("name", DECODED)
def test_decoded_blocks_have_the_published_digest(spark, name):
    blocks = spark.createDataFrame(list(enumerate(fixtures.generated_blocks()[name])), "id int, block binary")
    rows = decode.decode_blocks(blocks, name).orderBy("id", "t").select("r", "g", "b", "a").collect()
    assert hashlib.sha256(bytes(v for r in rows for v in r)).hexdigest() == DECODED[name]


@pytest.mark.parametrize(("name", "image"), ENCODED)
def test_encoded_images_have_the_published_digest(spark, name, image):
    texels = fixtures.image(spark, image)
    blocks = encode.encode_blocks(surfaces.blocks_of_texels(texels), name, [*surfaces.SURFACE, "bx", "by", "block_id"])
    payload = surfaces.payloads(blocks).first().payload
    again = surfaces.to_blocks(spark.createDataFrame([(0, 0, 0, 64, 64, payload)], "texture_id int, face int, mip int, width int, height int, payload binary"), name)
    decoded = surfaces.rasters(surfaces.placed(decode.decode_blocks(again, name))).first().rgba
    assert hashlib.sha256(bytes(payload) + bytes(decoded)).hexdigest()[:16] == ENCODED[name, image]


def test_signed_vectors(spark):
    # Endpoints -64 and 64 with index t % 8, and an endpoint of -128.
    word = sum((t % 8) << (3 * t) for t in range(16)).to_bytes(6, "little")
    rows = decode.decode_blocks(spark.createDataFrame([(b"\xc0\x40" + word,)], "block binary"), "BC4S").orderBy("t").collect()
    assert [r.r for r in rows] == [63, 192, 89, 114, 141, 166, 0, 255] * 2
    assert decode.decode_blocks(spark.createDataFrame([(b"\x80\x7f" + bytes(6),)], "block binary"), "BC4S").first().r == 0


def test_bc7_mode_6_vectors(spark):
    # Endpoints (100, 50, 30, 120) and (20, 110, 10, 60) without P-bits.
    def block(second, index):
        bits, at = 1 << 6, 7
        for a, b in zip((100, 50, 30, 120), second, strict=True):
            bits |= a << at | b << (at + 7)
            at += 14
        at += 2
        for t in range(16):
            bits |= (index if t else min(index, 7)) << at
            at += 4 if t else 3
        return bits.to_bytes(16, "little")

    df = spark.createDataFrame([(0, block((100, 50, 30, 120), 0)), (1, block((20, 110, 10, 60), 15))], "id int, block binary")
    rows = decode.decode_blocks(df, "BC7").where("t = 5").orderBy("id").collect()
    assert [tuple(r)[2:] for r in rows] == [(200, 100, 60, 240), (40, 220, 20, 120)]


def test_bc6h_reserved_modes_are_zeros_and_others_are_finite(spark):
    blocks = [bytes([c]) + b"\x5a" * 15 for c in (0x13, 0x17, 0x1B, 0x1F)] + fixtures.generated_blocks()["BC6H"]
    df = spark.createDataFrame(list(enumerate(blocks)), "id int, block binary")
    for name, largest in (("BC6HU", 0x7BFF), ("BC6HS", 0xFBFF)):
        rows = decode.decode_blocks(df, name).collect()
        assert all(r.r16 == r.g16 == r.b16 == 0 for r in rows if r.id < 4)
        assert all(0 <= v <= largest and v & 0x7FFF <= 0x7BFF for r in rows for v in (r.r16, r.g16, r.b16))
        assert any(r.r16 for r in rows)


@pytest.mark.parametrize("name", UNPACK)
def test_pixels_survive_packing(spark, name):
    size = format_of(name).size
    words = [k * 2654435761 % (1 << (8 * size)) for k in range(300)]
    pixels = decode.unpack_pixels(spark.createDataFrame([(w,) for w in words], "w long"), name)
    again = encode.pack_pixels(pixels.withColumnRenamed("w", "before"), name)
    for r in again.collect():
        expected = r.before | 0xFF000000 if name == "BGRX8" else r.before
        if name in ("R8S", "RG8S"):  # -128 counts as -127
            expected = sum((0x81 if b == 0x80 else b) << (8 * k) for k, b in enumerate(expected.to_bytes(size, "little")))
        if name == "RGB10A2":  # eight bits of ten
            continue
        assert r.w == expected


def test_packed_16_bit_vectors(spark):
    # Words and their pixels.
    for name, word, pixel in (("RGB565", 0xF800, (255, 0, 0, 255)), ("RGBA5551", 0xFC00, (255, 0, 0, 255)), ("RGBA5551", 0x7C00, (255, 0, 0, 0)), ("RGBA4444", 0xFF00, (255, 0, 0, 255)), ("RGBA4444", 0x8F00, (255, 0, 0, 136)), ("RGB10A2", 0xA02003FF, (255, 0, 128, 170))):
        assert tuple(decode.unpack_pixels(spark.createDataFrame([(word,)], "w long"), name).first())[1:] == pixel


def test_mips(spark):
    rows = [(0, 0, 0, 3, 1, x, 0, *p) for x, p in enumerate([(10, 20, 30, 40), (30, 40, 50, 60), (100, 120, 140, 160)])]
    texels = spark.createDataFrame(rows, "texture_id int, face int, mip int, width int, height int, x int, y int, r int, g int, b int, a int")
    chain = mips.mip_chain(texels, 0)
    assert tuple(chain.where("mip = 1").first())[5:] == (0, 0, 20, 30, 40, 50)
    for (w, h), sizes in {(8, 4): [(8, 4), (4, 2), (2, 1), (1, 1)], (5, 1): [(5, 1), (2, 1), (1, 1)], (7, 5): [(7, 5), (3, 2), (1, 1)]}.items():
        got = mips.mip_chain(fixtures.image(spark, "opaque", w, h), 0, srgb=True).groupBy("mip", "width", "height").count().orderBy("mip").collect()
        assert [(r.width, r.height) for r in got] == sizes and all(r["count"] == r.width * r.height for r in got)


def test_srgb_mips_of_one_colour_keep_it(spark):
    texels = fixtures.image(spark, "opaque", 4, 4).withColumn("r", F.lit(77)).withColumn("g", F.lit(200)).withColumn("b", F.lit(3))
    assert tuple(mips.downscaled(texels, srgb=True).first())[7:] == (77, 200, 3, 255)


def test_edges_repeat_and_are_cut_again(spark):
    texels = fixtures.image(spark, "translucent", 18, 14)
    keys = [*surfaces.SURFACE, "bx", "by", "block_id"]
    cells = surfaces.blocks_of_texels(texels)
    assert cells.groupBy(*keys).count().where("count <> 16").count() == 0
    back = surfaces.placed(cells).select(texels.columns)
    assert back.count() == 18 * 14 and back.exceptAll(texels).count() == 0


def test_psnr(spark):
    a, by = fixtures.image(spark, "opaque"), ["texture_id"]
    assert metrics.psnr(a, a, by, ["x", "y"]).first().psnr == float("inf")
    off = a.withColumn("r", F.col("r") + 3)
    assert metrics.psnr(a, off, by, ["x", "y"]).first().psnr == pytest.approx(43.3588, abs=1e-3)  # 10 log10(255^2 / 3)


def test_wrong_blocks_and_formats_are_refused(spark):
    with pytest.raises(Exception, match="16 bytes"):
        decode.decode_blocks(spark.createDataFrame([(b"short",)], "block binary"), "BC7").collect()
    with pytest.raises(ValueError, match="no blocks"):
        decode.decode_blocks(spark.createDataFrame([(b"",)], "block binary"), "RGBA8")
    with pytest.raises(ValueError, match="unknown"):
        format_of("BC9")
    assert decode.decode_blocks(spark.createDataFrame([(None,)], "block binary"), "BC1").collect() == []


def test_sizes():
    assert len(FORMATS) == 24 and format_of("DXT5").name == "BC3"
    assert level_size(format_of("BC1"), 18, 14) == 5 * 4 * 8 and level_size(format_of("RGB8"), 3, 2) == 18
    assert [mip_count(*s) for s in ((8, 4), (5, 1), (1, 1))] == [4, 3, 1]


# First eight bytes of SHA-256 of the 64x64 images encoded at levels 1 to 10, then decoded.
LEVELS = {
    ("BC1", "opaque"): "645bebcb02564fba 49022b4011bc1ddd 122400b9c696028a d765ea758656b179 04abe32437d913d3 086c9a5a46b258b7 be3fb6ee9f0e8706 3f5d21d232f1592f 13cdb6ac1be82601 c29052c9f02e1bcf",
    ("BC1", "translucent"): "0f2d56329e5adbaa f2cdc3180f61b389 052c7b2e6d349c03 59fc241c2e771f12 90f13979ea874bdf 1d064a543929425c b101a8ec39975c66 7cafcda90ce77b87 0632379ec630dff2 aec3701cdf5677ff",
    ("BC2", "translucent"): "b0b375a13743fd27 c1b8b0061a98f19e e8bb7e07a2d0d946 475793c0dfc0b713 f585fe1ef5d219f7 a9d917310f873da0 40f10292f8497676 a9cfa8e20b8418d2 ab9643b36f91f24b 8e77c95ad95b244a",
    ("BC3", "translucent"): "c2af7a143698e692 359843aeb5d1cd4c d2f61ad341876a40 727da9ef9495f675 e7963ee34b751b03 70b3b8b6f8f29e15 7272b3ab002aca55 8863e14a635c2798 35f00ab0bb2149d5 123cfc9ff11bde4c",
    ("BC3", "nohq"): "8b732676827b3617 8372d844da2ec237 fbde30eb8d508e1b 53298e682d2921f3 820c18adeb4c8df8 a1de3e30e4a22a2a 53af96172ee42de9 e9505a3f2731bd7a 016eb16aad2b1565 016eb16aad2b1565",
    ("BC4", "opaque"): "b63e66185a881fd6 " + "4f4e3f564d05246c " * 6 + "778a4651318576fe " * 3,
    ("BC5", "opaque"): "51bfd7a4de1a48c9 " + "b735707000d9e609 " * 6 + "330bcfc40f2875fc " * 3,
    ("BC4S", "opaque"): "0a1fcccb8b9c1fa5 9a48e581600f0938 " + "66f98ddd67d95c1b " * 8,
    ("BC5S", "opaque"): "0c714ffcf6660503 15a74ff51615f22b " + "866fd5f85ab1b615 " * 8,
    ("BC7", "opaque"): "676bc14c0e70df41 " + "a8495ee1c31144c6 " * 2 + "1b967653bb24b65a " * 3 + "25855d0290901ffb " * 2 + "f6d2c255f5ac6d64 f1e2fe57dbf63121",
    ("BC7", "translucent"): "80f1cd8d9ca86319 " + "f4c2e8252dbe4fc8 " * 2 + "004f46b918859a66 " * 3 + "a092a73d21ea9d17 " * 2 + "bdd359b7d3e6f0a9 2020711052772849",
}


@pytest.mark.parametrize(("name", "image"), LEVELS)
def test_searched_encodings_have_the_published_digests(spark, name, image):
    """All levels at once: each level is a texture, and blocks are decoded by the expressions."""
    want = LEVELS[name, image].split()
    rgba = bytes(surfaces.rasters(fixtures.image(spark, image)).first().rgba)
    frame = spark.createDataFrame([(0, 0, 0, 64, 64, rgba)], "texture_id int, face int, mip int, width int, height int, rgba binary")
    encoded = None
    for level in range(1, len(want) + 1):
        one = search.encode_surfaces(frame, name, level).withColumn("texture_id", F.lit(level))
        encoded = one if encoded is None else encoded.unionByName(one)
    payloads = {r.texture_id: bytes(r.payload) for r in encoded.collect()}
    again = spark.createDataFrame([(k, 0, 0, 64, 64, p) for k, p in payloads.items()], "texture_id int, face int, mip int, width int, height int, payload binary")
    decoded = {r.texture_id: bytes(r.rgba) for r in surfaces.rasters(surfaces.placed(decode.decode_blocks(surfaces.to_blocks(again, name), name))).collect()}
    got = [hashlib.sha256(payloads[k] + decoded[k]).hexdigest()[:16] for k in sorted(payloads)]
    assert got == want


def test_surfaces_with_odd_sizes_and_nulls(spark):
    rgba = bytes(range(256)) * 3
    frame = spark.createDataFrame([(1, 18, 10, rgba[: 18 * 10 * 4] + bytes(max(0, 18 * 10 * 4 - 768))), (2, 4, 4, None)], "id int, width int, height int, rgba binary")
    rows = {r.id: r for r in search.encode_surfaces(frame, "DXT5", 2).collect()}
    assert rows[2].payload is None and len(rows[1].payload) == 5 * 3 * 16 and rows[1].format == "BC3"
    with pytest.raises(ValueError, match="no encoder"):
        search.encode_array(search.blocks_of(bytes(64), 4, 4), "BC6HU")


def test_weights_and_own_searches(spark):
    blocks = search.blocks_of(bytes(surfaces.rasters(fixtures.image(spark, "opaque")).first().rgba), 64, 64)
    assert search.fixed_weights(0.3, 0.6, 0.1).tolist() == search.GENERAL.tolist() and search.fixed_weights(-1, 0, 0).tolist() == [0, 0, 0]
    same = search.encode_array(blocks, "BC1", 6)
    assert (search.encode_array(blocks, "BC1", search.LEVELS[6], weights=(0.3, 0.6, 0.1)) == same).all()
    assert (search.encode_array(blocks, "BC1", 6, weights=(1, 0, 0)) != same).any()
    assert (search.encode_array(blocks, "BC1", 99) == search.encode_array(blocks, "BC1", 10)).all()


# First eight bytes of SHA-256 of the 64x64 HDR image encoded at levels 1 to 10, then decoded.
HDR = {
    "BC6HU": "dd7dc80381029671 " + "e509f7ee6e05549f " * 2 + "d6155550e1dc8a27 " * 4 + "b6b179bbd0a84dfb " * 3,
    "BC6HS": "3beb645d3bbbe7c6 " + "ab112c70855ed726 " * 2 + "d4ac8130bda6692a " * 4 + "a1cc3f7a98445ee8 " * 3,
}


@pytest.mark.parametrize("name", HDR)
def test_hdr_encodings_have_the_published_digests(spark, name):
    y, x = np.mgrid[0:64, 0:64]
    image = np.stack([x / np.float32(63), y / np.float32(63), np.where((x // 8 + y // 8) % 2 == 0, 8.0, 1.0)], axis=2)
    halves = bc6h.to_half(image).astype("<u2").tobytes()
    frame = spark.createDataFrame([(0, 64, 64, halves), (1, 4, 4, None)], "texture_id int, width int, height int, rgb16 binary")
    for level, want in enumerate(HDR[name].split(), 1):
        if level in (3, 5, 6, 7, 9):  # these search as the one before does
            continue
        payloads = {r.texture_id: r.payload for r in bc6h.encode_hdr_surfaces(frame, name == "BC6HS", level).collect()}
        payload = bytes(payloads[0])
        texels = bptc.decode_bc6h(np.frombuffer(payload, np.uint8).reshape(-1, 16), name == "BC6HS")
        decoded = texels.astype("<u2").reshape(16, 16, 4, 4, 3).transpose(0, 2, 1, 3, 4).tobytes()
        assert hashlib.sha256(payload + decoded).hexdigest()[:16] == want and payloads[1] is None


def test_half_floats(spark):
    # Floats and their half-float bits.
    for value, bits in ((0.0, 0), (-0.0, 0x8000), (1, 0x3C00), (-1, 0xBC00), (2, 0x4000), (0.5, 0x3800), (-0.5, 0xB800), (65504, 0x7BFF), (-65504, 0xFBFF), (2**-14, 0x0400), (2**-24, 1), (np.inf, 0x7C00), (-np.inf, 0xFC00), (1e10, 0x7C00), (2**-30, 0)):
        assert bc6h.to_half(np.array([value]))[0] == bits
    every = np.arange(65536).astype(np.uint16)
    nan = (every & 0x7C00 == 0x7C00) & (every & 0x3FF > 0)
    assert (bc6h.to_half(bc6h.from_half(every))[~nan] == every[~nan]).all() and np.isnan(bc6h.from_half(every[nan])).all()
    got = apply(spark.range(65536).selectExpr("CAST(id AS BIGINT) AS h"), [{"value": halves.to_double("h")}]).orderBy("h").toPandas().value.to_numpy()
    assert np.array_equal(got.astype(np.float32), bc6h.from_half(every), equal_nan=True)
