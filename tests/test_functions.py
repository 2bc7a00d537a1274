"""Scalar functions against known values."""

import pytest
from pyspark.sql import functions as F

from weftgraph import functions as fn
from weftgraph.functions.hashing import rapid64
from weftgraph.sources.manifest import canonical

PATHS = {
    "foo.h": "foo.h", "./foo.h": "foo.h", "./foo/./bar.h": "foo/bar.h", "./x/foo/../bar.h": "x/bar.h", "./x/foo/../../bar.h": "bar.h", "foo//bar": "foo/bar",
    "foo//.//..///bar": "bar", "./x/../foo/../../bar.h": "../bar.h", "foo/./.": "foo", "foo/bar/..": "foo", "foo/.hidden_bar": "foo/.hidden_bar", "/foo": "/foo",
    "//foo": "/foo", "/": "/", "aa/..": ".", "..": "..", "../": "..", "../foo": "../foo", "a/b/c/d/e/../../../../f": "a/f", "./": ".", ".": ".", "": "", "/..": "/..", "../../x": "../../x",
}


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_canonical_path(spark):
    rows = spark.createDataFrame(list(PATHS.items()), "x string, y string").select("x", "y", fn.canonical_path(F.col("x")).alias("z")).collect()
    assert [(r.x, r.z) for r in rows] == [(r.x, r.y) for r in rows]
    assert {x: canonical(x) for x in PATHS} == PATHS


@pytest.mark.parametrize(("path", "folder"), [("foo.c", ""), ("a/b/c.c", "a/b"), ("/a/b.c", "/a"), ("/b.c", ""), ("a//b.c", "a")])
def test_dir_name(spark, path, folder):
    assert one(spark, path, fn.dir_name) == folder


def test_quoting(spark):
    shell = {"": "", "plain": "plain", "/usr/bin/gcc-9.2": "/usr/bin/gcc-9.2", "with space": "'with space'", "hi'there": "'hi'\\''there'", "$PATH": "'$PATH'"}
    win = {"plain": "plain", "a b": '"a b"', 'a"b': '"a\\"b"', "a\\": "a\\", "a b\\": '"a b\\\\"', 'a\\"b': '"a\\\\\\"b"'}
    for table, f in ((shell, fn.shell_escape), (win, fn.win32_escape)):
        rows = spark.createDataFrame(list(table.items()), "x string, y string").select("y", f(F.col("x")).alias("z")).collect()
        assert [r.z for r in rows] == [r.y for r in rows]


def test_decanonicalize(spark):
    long = "/".join("x" * 70)
    rows = [("a/b/c", 1, "a\\b/c"), ("a/b/c", 2, "a/b\\c"), ("a/b/", 3, "a\\b\\"), ("a/b", 0, "a/b"), ("", 1, ""), ("/a", 1, "\\a"), (long, -1, long.replace("/", "\\", 64))]
    got = spark.createDataFrame(rows, "x string, k long, y string").select("y", fn.decanonicalize(F.col("x"), F.col("k"), windows=True).alias("z"), fn.decanonicalize(F.col("x"), F.col("k")).alias("same"), "x").collect()
    assert [r.z for r in got] == [r.y for r in got]
    assert [r.same for r in got] == [r.x for r in got]


def test_clock(spark):
    assert one(spark, "1970-01-01T00:00:01.234567Z", lambda c: fn.now_millis(c.cast("timestamp"))) == 1234
    assert one(spark, "", lambda c: fn.now_millis()) > 1_600_000_000_000
    assert one(spark, "", lambda c: fn.format_mtime(F.lit(-5))) == "-5"


def test_text(spark):
    assert one(spark, "\x1b[31mred\x1b[0m", fn.strip_ansi) == "red"
    assert one(spark, "a\x1b[1", fn.strip_ansi) == "a"
    assert one(spark, "a\x1bb", fn.strip_ansi) == "ab"
    assert [one(spark, "0123456789", lambda c, w=w: fn.elide_middle(c, w)) for w in (10, 7, 3, 1)] == ["0123456789", "01...89", "...", "."]
    assert one(spark, "\x1b[31m0123456789\x1b[0m", lambda c: fn.elide_middle_ansi(c, 7)) == "\x1b[31m01...89\x1b[0m"
    assert one(spark, 'a"b\\c\nd', fn.json_escape) == 'a\\"b\\\\c\\nd'
    assert one(spark, "\x01é", fn.json_escape) == "\\u0001é"
    assert [one(spark, x, fn.atoi) for x in ("12x", " -3", "+7", "x", "", "99999999999")] == [12, -3, 7, 0, 0, 2**31 - 1]
    assert [one(spark, x, fn.version_check) for x in ("1.13", "1.5", "0.9", "1.14", "2.0", "1")] == ["ok", "ok", "older", "newer", "newer", "ok"]
    assert one(spark, "kitten", lambda c: fn.edit_distance(c, F.lit("sitting"), 3)) == 3
    assert one(spark, "abcdef", lambda c: fn.edit_distance(c, F.lit("uvwxyz"), 3)) == 4
    assert one(spark, "bild", lambda c: fn.suggestion(c, F.array(F.lit("test"), F.lit("build"), F.lit("bold")))) == "build"


def test_show_includes(spark):
    got = one(spark, "foo.cc\r\nNote: including file:  b.h\nNote: including file: C:\\Program Files\\x.h\nNote: including file: ./a.h\nwarning\n", fn.show_includes)
    assert (got.includes, got.output) == (["a.h", "b.h"], "warning\n")


def test_response_file(spark):
    f = lambda command: one(spark, command, lambda c: fn.inline_response_file(c, F.lit("x.rsp"), F.lit("a\nb")))
    assert [f("cc @x.rsp o"), f("cc -f x.rsp o"), f("cc --option-file=x.rsp o"), f("cc x.rsp"), f("cc")] == ["cc a b o", "cc a b o", "cc a b o", "cc x.rsp", "cc"]


def test_hash(spark):
    command = 'cp a.txt b.txt && printf "b.txt: a.txt extra.h\\n" > b.txt.d'
    assert rapid64(command.encode()) == 0xC5838A4B554D43E9
    assert one(spark, command, fn.rapidhash) == "c5838a4b554d43e9"
    assert len({rapid64(b"x" * n) for n in range(300)}) == 300
    assert one(spark, "c", lambda c: fn.hash_input(c, F.lit("r"))) == "c;rspfile=r"


def test_status(spark):
    line = fn.progress_line("[%f/%t %p %r %u %s %o %c %e %w %E %W %P %% %x]", F.lit(4), F.lit(10), F.lit(1), F.lit(3), F.lit(6000), F.lit(-1.0), F.lit(0.25))
    assert one(spark, "", lambda c: line) == "[3/10  30% 1 6 4 0.5 ? 6.000 00:06 18.000 00:18  25% % %x]"
    share = lambda *a: one(spark, "", lambda c: fn.predicted_share(*[F.lit(x) for x in a]))
    assert share(10, 0, 0, 0, 0, 0, 0, 0, 10) == 0
    assert share(10, 5, 1000, 500, 0, 0, 0, 0, 5) == pytest.approx(0.5)
    assert share(4, 2, 1000, 200, 2, 600, 4, 800, 0) == pytest.approx(0.25)
    assert share(4, 2, 20_000, 20_000, 2, 60, 4, 80, 0) == pytest.approx(0.5)  # earlier times are far off
    assert [one(spark, "", lambda c, a=a: fn.exit_status(F.lit(a[0]), F.lit(a[1]))) for a in ((3, 0), (0, 2), (0, 9))] == [3, 130, 137]


def test_status_lines_beyond_ten_times_the_total(spark, tmp_path):
    import duckdb

    from weftgraph.plans import queries

    ids = [0, 7, 19_999, 20_000, 199_999, 200_000, 599_999, 5_999_999]
    spark.createDataFrame([(x,) for x in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.line for r in queries.status_lines(spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        assert got == dict(con.execute(queries.ORACLES["status_lines"]).fetchall())
    assert got[200_000] == "[200000/20000 100% 20.0]"
    whole = spark.range(1).select(fn.progress_line("%p", F.lit(0), F.lit(20000), F.lit(0), F.lit(200_000), F.lit(1), F.lit(-1.0), F.lit(0.0)).alias("x")).first().x
    assert whole == "1000%"
