import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mathloom import schema
from mathloom.operators import images, optional, pixels, render, renderers


def page():
    image = np.full((300, 400), 255, np.uint8)
    image[50:100, 50:150] = 0
    image[200:250, 200:350] = 0
    image[10:14, 10:14] = 0
    return image


def test_codec():
    image = page()
    assert (pixels.decode(pixels.encode(image)) == image).all()
    colour = b"P6\n# note\n2 1\n255\n" + bytes([255, 0, 0, 255, 255, 255])
    assert pixels.grey(pixels.decode(colour)).tolist() == [[76, 255]]
    for bad in (b"", b"PNG", b"P5 2 2 65535\n"):
        with pytest.raises(ValueError):
            pixels.decode(bad)


def test_quality():
    assert pixels.is_high_quality(page())
    assert not pixels.is_high_quality(page()[:50]) and not pixels.is_high_quality(np.full((200, 200), 120, np.uint8))


def test_resize():
    assert pixels.resize(np.full((50, 200), 9, np.uint8)).shape == (100, 400)
    big = pixels.resize(np.full((10, 5000), 9, np.uint8), images.OCRConfig(min_size=1))
    assert big.shape == (8, 4096) and (big == 9).all()
    same = np.zeros((200, 300), np.uint8)
    assert pixels.resize(same) is same


def test_steps():
    noisy = np.random.default_rng(1).normal(128, 10, (120, 130)).clip(0, 255).astype(np.uint8)
    assert pixels.denoise(noisy).std() < noisy.std()
    specks = np.full((120, 120), 200, np.uint8)
    specks[60, 60] = 0
    assert pixels.enhance(specks)[60, 60] > 100
    done = pixels.preprocess(noisy)
    assert set(np.unique(done)) <= {0, 255} and done.mean() >= 127
    assert pixels.preprocess(page()) is not None and (pixels.preprocess(page()) == page()).all()


def test_regions():
    assert pixels.regions(page()) == [(45, 45, 110, 60), (195, 195, 160, 60)]
    assert pixels.regions(np.zeros((100, 100), np.uint8)) == [] == pixels.regions(np.full((100, 100), 255, np.uint8))
    ring = np.full((200, 200), 255, np.uint8)
    ring[20:80, 20:80] = 0
    ring[40:60, 40:60] = 255
    ring[80:90, 80:120] = 0  # touches by a corner
    assert pixels.regions(ring) == [(15, 15, 110, 80)]


def test_frames(spark):
    df = spark.createDataFrame([(1, bytearray(pixels.encode(page()))), (2, bytearray(b"PNG")), (3, None)], "id int, content binary")
    got = {r.id: r for r in pixels.preprocess_images(df).collect()}
    assert pixels.decode(bytes(got[1].prepared)).shape == (300, 400) and got[2].prepare_error and got[3].prepared is None
    found = pixels.math_regions(df, ("id",)).collect()
    assert [(r.id, r.x, r.width) for r in found] == [(1, 45, 110), (1, 195, 160)]
    assert pixels.decode(bytes(found[0].content)).shape == (60, 110)
    assert pixels.math_regions(df.limit(0), ("id",)).count() == 0


def reply(url, headers, body, timeout):
    return {"latex_styled": "x^2", "latex_confidence": 0.9, "asciimath": "x^2"} if body["src"].endswith("YQ==") else {"error": "no formula"}


class Text:
    name = "text"

    def is_available(self):
        return True

    def recognize(self, content):
        return {"text": "a/b", "confidence": 0.5}


def test_backends(spark):
    service = images.HttpOCR("u", {"key": "k"}, reply)
    assert service.is_available() and not images.HttpOCR("u", {"key": ""}, reply).is_available() and not images.LocalOCR().is_available()
    df = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"b"))], "id int, content binary")
    got = {r.id: (r.latex, r.backend, r.asciimath) for r in images.recognize(df, [images.LocalOCR(), service, Text()]).collect()}
    assert got == {1: ("x^2", "http", "x^2"), 2: (r"\frac{a}{b}", "text", None)}


def test_optional_libraries_give_null(spark):
    row = spark.createDataFrame([("x+1",)], "v string").select(optional.sympy_expression(F.col("v")).alias("s"), optional.library_mathml(F.col("v")).alias("m")).first()
    assert row.s is None or "x" in row.s
    assert row.m is None or "<math" in row.m


def test_plots(spark):
    p = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y")), F.struct(F.lit(2.0).alias("x"), F.lit(3.0).alias("y")))
    none = F.array().cast("array<struct<x:double,y:double>>")
    row = spark.range(1).select(render.svg_plot(F.lit("function"), p, F.lit("a<b")).alias("f"), render.svg_plot(F.lit("scatter"), p, F.lit(None).cast("string")).alias("s"), render.svg_plot(F.lit("bar"), p, F.lit("t")).alias("b"), render.svg_plot(F.lit("scatter"), none, F.lit("t")).alias("n"), F.size(render.vector_grid(F.lit(0.0), F.lit(1.0), 3)).alias("g")).first()
    assert 'points="0.00,600.00 800.00,0.00"' in row.f and "<title>a&lt;b</title>" in row.f and row.s.count("<circle") == 2 and row.b is None and row.n is None and row.g == 9


def unpacked(png):
    width, height = struct.unpack(">II", png[16:24])
    size, kind = struct.unpack(">I4s", png[33:41])
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and kind == b"IDAT"
    lines = np.frombuffer(zlib.decompress(png[41 : 41 + size]), np.uint8).reshape(height, -1)
    assert not lines[:, 0].any()
    return lines[:, 1:].reshape(height, width, -1).squeeze()


def test_images_for_services():
    grey, colour = page(), np.stack([page(), page() // 2, page()], axis=2)
    assert (unpacked(pixels.png(grey)) == grey).all() and (unpacked(pixels.png(colour)) == colour).all()
    assert pixels.thumbnail(colour, 40).shape == (30, 40, 3) and pixels.thumbnail(grey, 400) is grey
    wide = np.full((16, 4096), 200, np.uint8)
    assert (unpacked(pixels.prepared_png(pixels.encode(wide), images.OCRConfig(max_image_bytes=10))) == 200).all()
    assert unpacked(pixels.prepared_png(pixels.encode(wide))).shape == (16, 4096) and pixels.prepared_png(b"else") == b"else"


def test_vector_field(spark):
    arrow = F.struct(*(F.lit(v).alias(n) for n, v in (("x", 1.0), ("y", 2.0), ("u", 3.0), ("v", 4.0))))
    still = F.struct(*(F.lit(0.0).alias(n) for n in "xyuv"))
    none = F.array().cast("array<struct<x:double,y:double,u:double,v:double>>")
    row = spark.range(1).select(*(render.svg_vectors(a, F.lit(None).cast("string"), 100, 100, 10).alias(n) for n, a in (("one", F.array(arrow)), ("still", F.array(still)), ("none", none)))).first()
    # A single arrow begins in the corner and is as long as a cell.
    assert 'x1="0.00" y1="100.00" x2="6.00" y2="92.00"' in row.one and 'x2="0.00" y2="100.00"' in row.still and row.none is None


def test_schemas(spark):
    for name, ddl in schema.SCHEMAS.items():
        assert spark.createDataFrame([], ddl).columns, name


def test_renderers_say_what_is_there(spark):
    there = render.available([*renderers.LATEX, renderers.NodeMathML(), renderers.Molecule()])
    assert set(there) == {"pdflatex", "sympy", "matplotlib", "node", "molecule"}
    df = spark.createDataFrame([(1, "x^2")], "id int, latex string")
    row = render.render(df, [*renderers.LATEX]).first()
    assert render.valid(row.asDict()) or (row.error == "No LaTeX renderer available") is not any(there[r.name] for r in renderers.LATEX)


@pytest.mark.parametrize("output", ["line\n! Undefined.\nl.5 \\foo\n\nmore", "! a\nb\nc\n! d", "one\ntwo\n\nthree\nfour", "", "\n \n", "!"])
def test_error_messages_agree(spark, output):
    from mathloom.functions.latex import latex_error_message

    got = spark.createDataFrame([(output,)], "v string").select(latex_error_message(F.col("v")).alias("m")).first().m
    assert got == renderers.error_message(output)
