import json

import pytest
from pyspark.sql import functions as F

from mathloom.functions.register import register
from mathloom.operators import detect, images, render, stats
from mathloom.plans import pipeline
from mathloom.sources import export, files
from mathloom.streaming import detect_stream as S


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "Let $x + 1$ and $$y}$$", "a.txt"), (2, None, None), (3, "nothing", "b")], "doc_id int, text string, source string")


def test_process(docs):
    got = {r.doc_id: r for r in pipeline.process(docs, source_file="source").collect()}
    assert [f.latex for f in got[1].formulas] == ["x + 1", "y}", "y}"]
    assert [w.type for w in got[1].warnings] == ["parse_warning"] * 2 and got[1].warnings[0].errors[0].type == "unmatched_brace"
    assert got[1].statistics.formula_types == {"inline": 2, "display": 1} and got[1].success and got[1].errors == []
    assert "Failed to convert: x + 1..." in got[1].formulas[0].mathml
    assert got[2].formulas == [] and got[3].statistics.total_formulas == 0
    long = docs.limit(1).withColumn("text", F.concat(F.lit("$"), F.repeat(F.lit("x"), 10_001), F.lit("$")))
    assert pipeline.process(long).first().warnings[0].type == "mathml_conversion"


def failing(part, inside):
    def run(value, *rest):
        if part in value:
            raise ValueError(f"no {part}")
        return inside(value, *rest)

    return run


def test_failures_stay_with_their_document(spark):
    df = spark.createDataFrame([(1, "$a$ $b$ $c$"), (2, "$b$ boom"), (3, None), (4, "$d{$")], "doc_id int, text string")
    steps = pipeline.Steps(find=failing("boom", detect.find), errors_of=failing("b", pipeline.errors_of), convert=failing("c", pipeline.convert))
    config = pipeline.ProcessConfig(semantics="intended", timed=True)
    got = {r.doc_id: r for r in pipeline.process(df, config, steps=steps).collect()}
    assert [f.latex for f in got[1].formulas] == ["a", "c"] and [tuple(e) for e in got[1].errors] == [("formula_extraction", "no b")] and not got[1].success
    assert got[1].formulas[0].mathml and got[1].formulas[1].mathml is None
    assert [(w.type, w.formula, w.errors[0].message) for w in got[1].warnings] == [("mathml_conversion", "c", "no c")]
    assert got[2].formulas == [] and [tuple(e) for e in got[2].errors] == [("general", "no boom")]
    assert got[3].success and got[3].errors == [] and got[4].success and got[4].warnings[0].type == "parse_warning"
    assert all(r.processing_time >= 0 for r in got.values())


def test_options(docs):
    off = pipeline.process(docs, pipeline.build_pipeline(extract_formulas=False)).where("doc_id = 1").first()
    assert off.formulas == []
    meant = pipeline.process(docs, pipeline.build_pipeline(semantics="intended", min_confidence=0.6)).where("doc_id = 1").first()
    assert "<mi>x</mi>" in meant.formulas[0].mathml and len(meant.formulas) == 2
    assert pipeline.process(docs.limit(0)).count() == 0


def test_exports(docs, tmp_path):
    results = pipeline.process(docs, source_file="source")
    as_json = json.loads(export.exported(results, "json").where("doc_id = 1").first().document)
    assert as_json["success"] and as_json["content"]["formulas"][0]["type"] == "inline" and as_json["content"]["formulas"][0]["position"] == [0, 40, 100, 20]
    latex = export.exported(results, "latex").where("doc_id = 1").first().document
    assert "\\subsection{Formula 2}\nType: display\n\n$$y}$$\n" in latex and latex.endswith("\n\\end{document}")
    markdown = export.exported(results, "markdown").where("doc_id = 1").first().document
    assert markdown.startswith("# Extracted STEM Content\n\nSource: a.txt\nProcessing time: n/a\n") and "- Formula types: {'inline': 2, 'display': 1}" in markdown
    assert export.export(results, str(tmp_path / "out"), "markdown") and not export.export(results, str(tmp_path / "no"), "pdf")
    with pytest.raises(ValueError):
        export.exported(results, "pdf")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("$x$\r\né".encode())
    (tmp_path / "b.TEX").write_text(r"\[ y \]")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.docx").write_bytes(b"PK")
    (tmp_path / "e.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "empty.tex").write_bytes(b"")
    paths = [str(tmp_path / n) for n in ("b.TEX", "none.txt", "a.txt", "c.pdf", "d.docx", "e.txt", "a.txt", "empty.tex")]
    got = {r.ordinal: (r.text, r.error_type, r.error) for r in files.scan_files(spark, paths).collect()}
    assert got == {
        0: (r"\[ y \]", None, None),
        1: (None, "file_not_found", f"File not found: {paths[1]}"),
        2: ("$x$\né", None, None),
        3: (None, "unsupported_format", "PDF processing not yet implemented"),
        4: (None, "unsupported_format", "Unsupported file format: .docx"),
        5: (None, "decode_error", "The file is not UTF-8"),
        6: ("$x$\né", None, None),
        7: ("", None, None),
    }
    folder = {r.source_file.rsplit("/", 1)[1]: r.error_type for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert folder == {"a.txt": None, "b.TEX": None, "c.pdf": "unsupported_format", "d.docx": "unsupported_format", "e.txt": "decode_error"}
    done = {r.ordinal: r for r in pipeline.process_files(spark, paths).collect()}
    assert len(done) == 8 and done[0].formulas[0].latex == "y" and done[0].success
    assert not done[1].success and done[1].errors[0].type == "file_not_found" and done[1].processing_time is None
    assert files.scan_files(spark, []).count() == 0


def test_stats(spark, docs):
    formulas = detect.detect(docs)
    v = stats.extraction_validation(formulas, ("doc_id",)).first()
    assert v.total == 3 and v.by_type == {"display": 1, "inline": 2} and v.potential_errors == [] and v.balanced_delimiters == 0
    report = stats.stats_report(formulas).first().report
    assert report.startswith("Total formulas detected: 3\n\nBy type:\n  - inline: 2\n  - display: 1\n\nConfidence levels:\n  - High (≥0.8): ")
    assert stats.quality(formulas.limit(0)).first().total == 0
    words = spark.createDataFrame([(1, 95), (1, 90), (1, -1), (2, -1), (2, None)], "id int, conf int")
    assert {r.id: r.confidence for r in stats.ocr_confidence(words, ("id",)).collect()} == {1: 0.925, 2: 0.0}


def test_sql_functions(spark):
    register(spark)
    row = spark.sql(r"SELECT latex_complexity('x') c, latex_is_valid('}') v, latex_to_mathml('x', true) m, mathml_is_valid('<math/>') b, latex_is_valid(NULL) n").first()
    assert row.c == pytest.approx(0.05 + 0.4) and row.v is False and 'display="block"' in row.m and row.b is False and row.n is None
    got = spark.sql("SELECT d.id, f.math_type, f.latex FROM VALUES (1, '$a$ $$b$$'), (2, NULL) AS d(id, text), LATERAL detect_formulas(d.text) f").collect()
    assert sorted(tuple(r) for r in got) == [(1, "display", "b"), (1, "inline", "a"), (1, "inline", "b")]


class Fake:
    def __init__(self, name, reply=None, available=True):
        self.name, self.reply, self.available = name, reply, available

    def is_available(self):
        return self.available

    def recognize(self, content):
        if self.reply is None:
            raise RuntimeError("broken")
        return self.reply

    def render(self, latex, config):
        return self.recognize(latex)


def test_recognition(spark):
    df = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"a")), (3, None)], "id int, content binary")
    good = Fake("good", {"latex": "x", "confidence": 0.9})
    got = {r.id: r for r in images.recognize(df, [Fake("off", available=False), Fake("bad"), good]).collect()}
    assert (got[1].latex, got[1].backend, got[1].error) == ("x", "good", None) and got[2].latex == "x" and got[3].latex is None
    assert images.recognize(df, []).where("id = 1").first().error == "No OCR backend available"
    assert images.recognize(df, [Fake("bad")]).where("id = 1").first().error == "broken"
    stop = images.recognize(df, [Fake("bad"), good], images.OCRConfig(enable_fallback=False)).where("id = 1").first()
    assert stop.error == "broken"


def test_retries():
    waits, replies = [], iter([OSError("x"), {"status": 429, "retry_after": 7}, {"status": 200}])

    def call():
        r = next(replies)
        if isinstance(r, Exception):
            raise r
        return r

    assert images.with_retries(call, sleep=waits.append) == {"status": 200} and waits == [1.0, 7.0]
    with pytest.raises(OSError):
        images.with_retries(lambda: (_ for _ in ()).throw(OSError("down")), sleep=waits.append)


def test_image_arithmetic(spark):
    row = spark.range(1).select(
        images.fitted_size(F.lit(50), F.lit(200)).alias("up"), images.fitted_size(F.lit(8192), F.lit(1000)).alias("down"), images.fitted_size(F.lit(200), F.lit(300)).alias("same"),
        images.padded_box(F.lit(2), F.lit(10), F.lit(96), F.lit(20), F.lit(100), F.lit(100)).alias("box"), images.keep_box(F.lit(95), F.lit(20), F.lit(100), F.lit(100)).alias("keep"),
        images.high_contrast(F.array_repeat(F.lit(1), 256)).alias("flat"), images.high_contrast(F.array([F.lit(9 if i < 50 else 0) for i in range(256)])).alias("dark"),
        images.valid_result(F.lit("x"), F.lit(0.5), F.lit(None).cast("string")).alias("ok"), images.valid_result(F.lit(""), F.lit(0.5), F.lit(None).cast("string")).alias("no"),
    ).first()
    assert tuple(row.up) == (100, 400) and tuple(row.down) == (4096, 500) and tuple(row.same) == (200, 300)
    assert tuple(row.box) == (0, 5, 100, 30) and not row.keep and not row.flat and row.dark and row.ok and not row.no


def test_rendering(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "id int, latex string")
    got = {r.id: r for r in render.render(df, [Fake("bad"), Fake("Good", {"svg": "<svg/>"})]).collect()}
    assert got[1].svg == got[2].svg == "<svg/>" and got[1].renderer == "Good" and got[3].error is None
    assert render.render(df, []).where("id = 1").first().error == "No LaTeX renderer available"
    assert render.render(df, [], only="tex").where("id = 1").first().error == "Unknown renderer: tex"
    assert render.render(df, [Fake("Tex", available=False)], only="tex").where("id = 1").first().error == "tex not available"
    render.save({"svg": "<svg/>"}, str(tmp_path / "a.svg"))
    assert (tmp_path / "a.svg").read_text() == "<svg/>"
    with pytest.raises(ValueError, match="No render result to save"):
        render.save({}, str(tmp_path / "b"))
    assert render.available([Fake("a"), Fake("b", available=False)]) == {"a": True, "b": False}
    routes = [tuple(r.r) for r in spark.createDataFrame([("chemical", "CCO"), ("chemical", None), ("scatter", None), ("bar", None), (None, None)], "k string, s string").select(render.diagram_route(F.col("k"), F.col("s")).alias("r")).collect()]
    assert routes == [("chemical", None), (None, "Unknown diagram type: chemical"), ("plot", None), (None, "Unknown diagram type: bar"), (None, "Unknown diagram type: None")]
    points = spark.range(1).select(render.polynomial_points(F.lit(2.0), F.lit(2.0), F.lit(1.0), F.lit(-1.0), F.lit(1.0), 3).alias("p")).first().p
    assert [(p.x, p.y) for p in points] == [(-1.0, 3.0), (0.0, 1.0), (1.0, 3.0)]


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("$x$ and $$y$$")
    formulas = S.detect_stream(S.text_stream(spark, str(source)), ("source_file", "arrived"))
    counts = S.windowed_type_counts(formulas, "arrived")
    stream = counts.writeStream.format("memory").queryName("found").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    stream.processAllAvailable()
    (source / "b.txt").write_text("$z$")
    stream.processAllAvailable()
    stream.stop()
    assert {(r.math_type, r.n) for r in spark.table("found").groupBy("math_type").agg(F.sum("n").alias("n")).collect()} == {("inline", 3), ("display", 1)}


def test_table_stream(spark, tmp_path):
    spark.createDataFrame([(1, "$x$")], "doc_id int, text string").write.parquet(str(tmp_path / "t"))
    stream = S.table_stream(spark, str(tmp_path / "t"), "doc_id int, text string")
    q = S.detect_stream(stream, ("doc_id",)).writeStream.format("memory").queryName("t").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("t").first().latex == "x"
