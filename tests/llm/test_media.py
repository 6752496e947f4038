import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from meadowlark.llm import media
from pyspark.sql import functions as F


@given(st.binary(min_size=1, max_size=1500))
@settings(max_examples=200, deadline=None)
def test_round_trip(data):
    payload = data + b"\0" * (-len(data) % 64)
    image = media.Image(media.encode_payload(payload))
    assert image.payload() == payload


@pytest.mark.parametrize("fill", [0, 127, 128, 255])
def test_extremes(fill):
    payload = bytes([fill]) * 64 * 41
    assert media.Image(media.encode_payload(payload)).payload() == payload


def test_bitwise_reading_agrees(monkeypatch):
    payload = bytes(np.random.default_rng(3).integers(0, 256, 64 * 13, dtype=np.uint8))
    stored = media.encode_payload(payload)
    fast = media.Image(stored)
    monkeypatch.setattr(media, "read_uniform", lambda *a: False)
    slow = media.Image(stored)
    assert (fast.coef == slow.coef).all() and slow.payload() == payload


def huffman(kind, symbols):
    """A table of codes of eight bits."""
    return media.segment(media.DHT, bytes([kind << 4, *[0] * 7, len(symbols), *[0] * 8, *symbols]))


def coded(symbols, parts):
    bits = "".join(format(symbols.index(x[0]), "08b") + x[1] if isinstance(x, tuple) else x for x in parts)
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def test_zero_runs_bands_and_refinement():
    """A grey block with zero runs, an end of band and coefficients that become known in a refining scan."""
    dc, ac = [0, 3], [0x00, 0x21, 0x01, 0xF0, 0x11]
    body = [
        b"\xff\xd8", media.segment(media.DQT, bytes([0, *[2] * 64])), media.segment(media.SOF2, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])), huffman(0, dc), huffman(1, ac),
        media.scan(1, 0, 0, 0, 1, coded(dc, [(3, "101")])), media.scan(1, 1, 63, 0, 1, coded(ac, [(0x21, "1"), (0x01, "0"), (0x00, "")])),
        media.scan(1, 0, 0, 1, 0, coded(dc, ["1"])), media.scan(1, 1, 63, 1, 0, coded(ac, [(0x11, "1"), (0x00, ""), "1", "0"])), b"\xff\xd9",
    ]
    image = media.Image(b"".join(body))
    want = np.zeros(64, int)
    want[[0, 2, 3, 4]] = [11, 1, 3, -2]
    got = image.coef[0]
    assert (got == want).all()
    plane = image.planes()[0].astype(float)
    spread = np.zeros((8, 8))
    spread.reshape(-1)[media.zigzag()] = got * 2
    k = np.arange(8)
    c = np.where(k[:, None] == 0, np.sqrt(0.5), 1) / 2 * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    assert np.abs(plane - np.clip(c.T @ spread @ c + 128, 0, 255)).max() <= 0.51
    assert image.rgb().shape == (8, 8, 3)


def test_columns(spark):
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "ü" * 5000), (5, "abc")], "doc_id long, text string")
    stored = df.withColumn("media", media.store_media(media.padded(F.col("text"))))
    got = {r.doc_id: r for r in media.media_features(stored).select("doc_id", "found.*").collect()}
    assert [got[k].payload_bytes for k in (1, 2, 3, 4)] == [64, 64, 64, 10048]
    assert got[1].feature == got[5].feature and got[2].payload_sha256 == got[3].payload_sha256 != got[1].payload_sha256
    t = stored.select("doc_id", media.rgb_tensors(F.col("media")).alias("t")).where("doc_id = 4").first().t
    assert len(t.data) == t.height * t.width * 3
    assert spark.createDataFrame([(b"junk",), (None,)], "m binary").select(media.rgb_tensors(F.col("m")).alias("t")).where("t IS NULL").count() == 2
    with pytest.raises(ValueError):
        media.encode_payload(b"abc")


def test_stored_media_and_tensors(spark, monkeypatch):
    """The media are read back from a Parquet table; every tensor is in the result, and the features are its own."""
    kept, write = [], media.stored
    monkeypatch.setattr(media, "stored", lambda df: kept.append(write(df)) or kept[-1])
    df = spark.createDataFrame([(1, "abc"), (2, "ü" * 5000), (3, "")], "doc_id long, text string").withColumn("media", media.store_media(media.padded(F.col("text"))))
    df = df.withColumn("decoded", F.lit("own")).withColumn("a.b", F.lit(2)).withColumn("found", F.lit("replaced"))
    rows = media.media_features(df).collect()
    assert len(kept) == 1 and kept[0].inputFiles() and len(rows) == 3
    for r in rows:
        want = plain_rgb(bytes(r.media))
        t = np.frombuffer(bytes(r.tensor.data), np.uint8).reshape(r.tensor.height, r.tensor.width, 3)
        assert t.shape == want.shape and np.abs(t.astype(int) - want).max() <= 3 and r.decoded == "own" and r["a.b"] == 2
        assert r.found.feature == f"{t.shape[0]}x{t.shape[1]}x3 rgb " + " ".join(map(str, t.reshape(-1, 3).sum(axis=0, dtype=int)))
    none = spark.createDataFrame([(1, None), (2, b"\xff\xd8\xff\xd9"), (3, b"junk"), (4, b"")], "doc_id long, media binary")
    assert media.media_features(none).where("found IS NULL AND tensor IS NULL").count() == 4


def idct(block):
    """Samples of an 8 x 8 block of dequantised coefficients, by the formula."""
    k = np.arange(8)
    c = np.where(k[:, None] == 0, np.sqrt(0.5), 1) / 2 * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    return np.clip(np.rint(c.T @ block @ c + 128), 0, 255)


def converted(planes, steps, height, width):
    """RGB by the JFIF formulas, chroma repeated."""
    y, cb, cr = (np.kron(p, np.ones(s))[:height, :width] for p, s in zip(planes, steps, strict=True))
    cb, cr = cb - 128, cr - 128
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)


def plain_rgb(stored):
    """RGB of a payload's image from its coefficients, one block at a time in floating point."""
    image = media.Image(stored)
    planes = []
    for c in image.parts.values():
        plane = np.zeros((c.rows * 8, c.cols * 8))
        for b in range(c.rows * c.cols):
            spread = np.zeros(64)
            spread[media.zigzag()] = c.coef[b]
            y, x = divmod(b, c.cols)
            plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = idct(spread.reshape(8, 8))
        planes.append(plane)
    return converted(planes, [(1, 1), (2, 2), (2, 2)], image.height, image.width)


def colour_image(rng, height, width):
    """A 4:2:0 progressive JPEG with many-symbol tables, one interleaved DC scan, its refinement and bands of AC, and
    its RGB by formula."""
    units = -(-height // 16), -(-width // 16)
    shapes = [(2 * units[0], 2 * units[1]), units, units]
    own = [(-(-height // 8), -(-width // 8)), *[(-(-(-(-height // 2)) // 8), -(-(-(-width // 2)) // 8))] * 2]
    coef = [np.zeros((r, c, 64), int) for r, c in shapes]
    for part, (r, c) in zip(coef, own, strict=True):
        part[:, :, 0] = rng.integers(-60, 60, part.shape[:2])
        for k in rng.integers(1, 64, 9):
            part[:r, :c, k] = rng.integers(-7, 8, (r, c))

    def bits_of(v):
        n = int(abs(v)).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    dc, ac = list(range(8)), [*(run << 4 | n for run in range(16) for n in range(1, 4)), 0x00, 0xF0]
    first, low, before = [], [], [0, 0, 0]
    for y in range(units[0]):
        for x in range(units[1]):
            for k, step in ((0, 2), (1, 1), (2, 1)):
                for j in range(step):
                    for i in range(step):
                        v = int(coef[k][y * step + j, x * step + i, 0])
                        n, bits = bits_of((v >> 1) - before[k])
                        before[k] = v >> 1
                        first.append((n, bits))
                        low.append(str(v & 1))
    q = [1 + k // 8 for k in range(64)]
    body = [b"\xff\xd8", media.segment(media.DQT, bytes([0, *q])), media.segment(media.SOF2, bytes([8, height >> 8, height & 255, width >> 8, width & 255, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), huffman(0, dc), huffman(1, ac)]
    body.append(media.segment(media.SOS, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 1])) + coded(dc, first).replace(b"\xff", b"\xff\x00"))
    for k in range(3):
        for lo, hi in ((1, 20), (21, 63)):
            parts = []
            for block in coef[k][: own[k][0], : own[k][1]].reshape(-1, 64):
                run = 0
                for v in block[lo : hi + 1].tolist():
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        parts.append((0xF0, ""))
                        run -= 16
                    n, bits = bits_of(v)
                    parts.append((run << 4 | n, bits))
                    run = 0
                if run:
                    parts.append((0x00, ""))
            body.append(b"\xff\xff" + media.scan(k + 1, lo, hi, 0, 0, coded(ac, parts))[1:])  # a fill byte before the marker
    body.append(media.segment(media.SOS, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x10])) + coded(dc, low).replace(b"\xff", b"\xff\x00"))
    planes = []
    for part in coef:
        plane = np.zeros((part.shape[0] * 8, part.shape[1] * 8))
        for y in range(part.shape[0]):
            for x in range(part.shape[1]):
                spread = np.zeros(64)
                spread[media.zigzag()] = part[y, x] * q
                plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = idct(spread.reshape(8, 8))
        planes.append(plane)
    return b"".join([*body, b"\xff\xd9"]), converted(planes, [(1, 1), (2, 2), (2, 2)], height, width)


def test_colour_against_formulas(spark):
    """Chroma and colour of images with odd sizes, decoded in Spark, beside the formulas."""
    rng = np.random.default_rng(11)
    made = [colour_image(rng, h, w) for h, w in ((16, 16), (24, 40), (37, 19))]
    df = spark.createDataFrame([(k, x[0]) for k, x in enumerate(made)], "k int, media binary")
    for r in df.select("k", media.rgb_tensors(F.col("media")).alias("t")).collect():
        got = np.frombuffer(bytes(r.t.data), np.uint8).reshape(r.t.height, r.t.width, 3)
        assert got.shape == made[r.k][1].shape and np.abs(got.astype(int) - made[r.k][1]).max() <= 3


@given(st.binary(max_size=300), st.integers(0, 2000))
@settings(max_examples=150, deadline=None)
def test_malformed_bytes(junk, at):
    whole = media.encode_payload(bytes(range(64)) * 2)
    for data in (junk, b"\xff\xd8" + junk, whole[:at], whole[: at % len(whole)] + junk + whole[at % len(whole) :]):
        try:
            media.Image(data).rgb()
        except media.MALFORMED:
            pass
