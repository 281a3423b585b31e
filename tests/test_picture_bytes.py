"""Header measures and sharpness of made pictures, whole, cut and of other kinds."""

import math
import random
import struct

from textloom.operators import picture_bytes as B


def jpeg(width, height, marker=0xC0, before=b""):
    app = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9)
    return b"\xff\xd8" + app + before + b"\xff" + bytes([marker]) + struct.pack(">HBHH", 17, 8, height, width) + bytes(30)


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height) + bytes(20)


def webp(kind, payload):
    return b"RIFF" + struct.pack("<I", 100) + b"WEBP" + kind + struct.pack("<I", 50) + payload + bytes(20)


CASES = [
    (jpeg(640, 480), (640, 480)), (jpeg(1, 65535, 0xC2, b"\xff\xdb" + struct.pack(">H", 5) + b"abc"), (1, 65535)), (jpeg(3, 4, 0xC1, b"\xff\xd8\xff\x01junk"), (3, 4)), (jpeg(9, 9, 0xC4), None),
    (jpeg(640, 480)[:26], None), (png(1600, 900), (1600, 900)), (png(70000, 3_000_000_000), (70000, 3_000_000_000)), (png(5, 6)[:23], None), (png(5, 6)[:24], (5, 6)),
    (webp(b"VP8 ", bytes(6) + struct.pack("<HH", 800 | 0x4000, 600)), (800, 600)), (webp(b"VP8L", b"\x2f" + struct.pack("<I", (1023) | (767 << 14))), (1024, 768)),
    (webp(b"VP8X", bytes(4) + (1919).to_bytes(3, "little") + bytes(1) + (1079).to_bytes(3, "little")), (1920, 1080)), (webp(b"VP8 ", bytes(6))[:29], None), (webp(b"ALPH", bytes(12)), None),
    (b"GIF89a" + bytes(40), None), (b"", None), (None, None), (b"\xff\xd8", None), (bytes(range(256)) * 200, None),
]


def plain_sharpness(data):
    if data is None or len(data) < 4:
        return 0.0
    diffs = [abs(a - b) for a, b in zip(data[:30000], data[1:30000])]  # noqa: B905
    mean = sum(diffs) / len(diffs)
    return math.sqrt(sum((d - mean) ** 2 for d in diffs) / len(diffs))


def test_sizes_and_sharpness(spark):
    rng = random.Random(1)
    cases = [*CASES, (bytes(rng.randrange(256) for _ in range(40_000)), None), (b"\xff\xd8" + b"\xff" * 50, None)]
    table = spark.createDataFrame([(k, data, "own") for k, (data, _) in enumerate(cases)], "k int, content binary, width string").repartition(3)
    rows = B.measured(table).orderBy("k").collect()
    assert [r["size"] and tuple(r["size"]) for r in rows] == [want for _, want in cases]
    assert all(math.isclose(r.sharpness, plain_sharpness(data), abs_tol=1e-9) for r, (data, _) in zip(rows, cases, strict=True))


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.png").write_bytes(png(10, 20))
    (tmp_path / "y.jpg").write_bytes(jpeg(30, 40))
    (tmp_path / "z.txt").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: (r["size"].width, r.length) for r in B.measured(B.read(spark, str(tmp_path), "*.{png,jpg}")).collect()}
    assert got == {"x.png": (10, len(png(10, 20))), "y.jpg": (30, len(jpeg(30, 40)))}
