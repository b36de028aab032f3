"""Scalar functions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from stratalens.functions import dates, paths, scores
from stratalens.functions import text as texts


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("text", "prefix", "want"),
    [("// a\nlet x=1;\n\n", "//", (4, 1, 1, 2)), ("/* a */\nx", "//", (2, 2, 0, 0)), ("# a\nx = 1", "#", (2, 1, 1, 0)), ("\u00a0\n\t# b\n", "#", (3, 0, 1, 2))],
)
def test_line_metrics(spark, text, prefix, want):
    assert tuple(value(spark, texts.line_metrics(lit(text), prefix))) == want


@pytest.mark.parametrize(
    ("path", "want"),
    [("Dockerfile.dev", "dockerfile"), ("a/Makefile", "makefile"), ("a.C", "cpp"), ("x.zzz", "unknown"), ("d/b.tsx", "typescript"), (".env", "config"), ("a.b/c", "unknown"), ("X.PY", "python")],
)
def test_language(spark, path, want):
    assert value(spark, paths.detect_language(lit(path))) == want


@pytest.mark.parametrize(
    ("path", "ext"), [("a/b.tar.gz", ".gz"), (".bashrc", ""), ("x/.a.b", ".b"), ("noext", ""), ("a.b/c", ""), ("a.", ".")]
)
def test_extension(spark, path, ext):
    assert value(spark, paths.extension(lit(path))) == ext


@pytest.mark.parametrize(
    ("source", "spec", "want"),
    [("/p/a.js", "./b.js", "/p/b.js"), ("/p/q/a.js", "../b", "/p/b"), ("/p/a.js", "lodash/fp", "lodash/fp"), ("/p/a.js", "/x/./y", "/x/y"), ("/p/a.js", "../../../z", "/z"), ("p/a.js", "./b", "p/b")],
)
def test_resolve_import(spark, source, spec, want):
    assert value(spark, paths.resolve_import(lit(source), lit(spec))) == want


def test_library_names_and_externals(spark):
    assert value(spark, paths.library_name(lit("@a/b/c"))) == "@a/b" and value(spark, paths.library_name(lit("lodash/fp"))) == "lodash"
    assert value(spark, paths.library_name_report(lit("./x/y"))) == "./x/y"
    for spec, analyzer, report in (("./a", False, False), ("..", False, True), (".x", False, True), ("/a", False, False), ("a", True, True)):
        assert value(spark, paths.is_external(lit(spec))) is analyzer and value(spark, paths.is_external_report(lit(spec))) is report


def test_routes_and_keys(spark):
    assert value(spark, paths.base_path(lit("/:id/users/:x"))) == "/users" and value(spark, paths.base_path(lit("/:id"))) == "/api"
    assert value(spark, paths.is_protected(lit("POST"), lit("/login"), lit("signIn"))) is False and value(spark, paths.is_protected(lit("DELETE"), lit("/x"), lit("f"))) is True
    assert value(spark, paths.sanitize_filename(lit("a b/c.é"))) == "a_b_c__" and value(spark, paths.sanitize_key(lit("a b/c.é"))) == "a_b/c._"
    assert [value(spark, paths.valid_key(lit(k))) for k in ("a/b", "/a", "a/../b", " ")] == [True, False, False, False]
    assert value(spark, paths.key_from_url(lit("http://h/x/avatars/u/1.png?v=2"))) == "avatars/u/1.png" and value(spark, paths.key_from_url(lit("http://h/x"))) is None
    assert value(spark, paths.location_category(lit("src/userService.ts"))) == "Services" and value(spark, paths.location_category(lit("a/b"))) == "Core"
    assert value(spark, paths.content_type(lit("a/B.MD"))) == "text/markdown" and value(spark, paths.content_type(lit("x"))) == "application/octet-stream"


def test_scores(spark):
    assert value(spark, scores.maintainability(lit(1), lit(0.0))) == 100
    mi = value(spark, scores.maintainability(lit(1_000_000), lit(1.0)))
    assert mi == pytest.approx(98.93, abs=0.01) and value(spark, scores.js_round(lit(mi))) == 99
    assert [value(spark, scores.cycle_severity(lit(n))) for n in (2, 3, 4, 6, 7)] == ["critical", "high", "high", "medium", "low"]
    assert value(spark, scores.cycle_impact(lit(12), lit(3))) == 40 and value(spark, scores.cycle_impact(lit(1000), lit(3))) == 100
    assert value(spark, scores.coupling(lit(3), lit(3))) == pytest.approx(1 / 3) and value(spark, scores.coupling(lit(0), lit(0))) is None
    assert value(spark, scores.project_scale(lit(51), lit(10))) == "Medium Scale"
    assert [value(spark, scores.clamp_progress(lit(n))) for n in (-1, 50, 200)] == [0, 50, 100]
    assert value(spark, scores.estimated_time(lit(1))) == "30 seconds" and value(spark, scores.estimated_time(lit(3))) == "2 minutes"
    assert [value(spark, scores.backoff_ms(lit(n))) for n in (0, 2, 10)] == [2000, 8000, 30000]
    assert value(spark, scores.js_round(lit(-2.5))) == -2


def test_texts(spark):
    assert value(spark, texts.js_trim(lit("\u00a0\t a b \u3000"))) == "a b"
    assert value(spark, texts.utf16_length(lit("😀a"))) == 3 and value(spark, texts.byte_length(lit("é"))) == 2
    assert value(spark, texts.capitalize_first(lit("aB c"))) == "AB c" and value(spark, texts.slug(lit("A  b c"))) == "a-b-c"
    assert [value(spark, texts.format_bytes(lit(n))) for n in (0, 500, 1024, 1536, 5 * 1024**4)] == ["0 Bytes", "500 Bytes", "1 KB", "1.5 KB", "5120 GB"]
    assert value(spark, texts.fenced_json(lit('x\n```json\n{"a": 3}\n```'), "a int")).a == 3 and value(spark, texts.fenced_json(lit('{"a": 4}'), "a int")).a == 4
    assert value(spark, texts.fenced_json(lit("nonsense"), "a int")).a is None
    assert value(spark, texts.worth_parsing(lit("x = 1"))) is False and value(spark, texts.worth_parsing(lit("0123456789\0"))) is False
    assert value(spark, texts.or_else(lit(0), lit(7))) == 7 and value(spark, texts.or_else(lit(2), lit(7))) == 2
    assert value(spark, texts.filled("Hi {{n}}, {{m}}!", {"n": lit("A"), "m": lit(None)})) == "Hi A, !"
    assert value(spark, texts.manifest(lit('{"dependencies": {"a": "1"}}'))).dependencies == {"a": "1"}


def test_dates(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    assert value(spark, dates.millis_between(ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:01.5"))) == 1500
    assert value(spark, dates.still_valid(ts("2024-01-01 00:06:00"), ts("2024-01-01 00:00:00"))) is True
    assert value(spark, dates.still_valid(ts("2024-01-01 00:05:00"), ts("2024-01-01 00:00:00"))) is False
    assert value(spark, dates.still_valid(F.lit(None).cast("timestamp"), ts("2024-01-01 00:00:00"))) is False
    assert value(spark, dates.iso(ts("2024-01-01 00:00:00"))) == "2024-01-01T00:00:00.000Z"
