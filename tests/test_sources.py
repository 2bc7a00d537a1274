"""Manifests, depfiles, dyndep files and logs."""

import os

import pytest

from weftgraph.plans.graph import BuildGraph
from weftgraph.sources import depfile, dyndep, files, logs
from weftgraph.sources.manifest import Manifest, ManifestError, Statement, parse_many, relation, serialize, unparse

CAT = "rule cat\n  command = cat $in > $out\n"


def parse(text, **files_):
    return Manifest(read=files_.get).parse("build.ninja", text)


def error(text, **files_):
    with pytest.raises(ManifestError) as e:
        parse(text, **files_)
    return str(e.value).split("\n")[0]


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("build out: nope\n", "unknown build rule 'nope'"), ("rule r\n", "expected 'command =' line"), ("rule r\n  command = x\n  bogus = 1\n", "unexpected variable 'bogus'"),
        ("rule r\n  command = x\nrule r\n  command = y\n", "duplicate rule 'r'"), (CAT + "build a: cat b\nbuild a: cat c\n", "multiple rules generate a"),
        (CAT + "build a a: cat b\n", "a is defined as an output multiple times"), (CAT + "build a: cat b\n\tx = 1\n", "tabs are not allowed, use spaces"),
        ("x = a$*b\n", "bad $-escape (literal $ must be written as $$)"), ("pool p\n", "expected 'depth =' line"), ("pool p\n  depth = -1\n", "invalid pool depth"), ("default nope\n", "unknown target 'nope'"),
        ("build\n", "expected path"), (CAT + "build out\n", "expected ':', got newline ($ also escapes ':')"), ("x = 1", "unexpected EOF"), ("include nope.ninja\n", "loading 'nope.ninja': No such file or directory"),
        ("rule r\n  command = x\n  rspfile = y\n", "rspfile and rspfile_content need to be both specified"), ("# no newline", "lexing error"), (CAT + "build a: cat b\n  pool = no\n", "unknown pool name 'no'"),
    ],
)
def test_errors(text, message):
    assert error(text).endswith(message)


def test_error_shows_the_place():
    with pytest.raises(ManifestError) as e:
        parse("# one\nbuild out: nope in\n")
    assert str(e.value) == "build.ninja:2: unknown build rule 'nope'\nbuild out: nope in\n           ^ near here"


def test_required_version():
    with pytest.raises(ManifestError, match="incompatible"):
        parse("ninja_required_version = 99.9\n")
    assert "greater than" in parse("ninja_required_version = 0.9\n").warnings[0]


def test_statements():
    m = parse(
        "v = top\nrule cc\n  command = cc $flags -o $out $in $v\n  description = CC ${out} $$\n  restat = 0\npool p\n  depth = 2\n"
        "build a$ b | c: cc x y$:z | h || o |@ t\n  flags = -O $v\n  pool = p\n  v = own\nbuild d: cc a$ b\nbuild all: phony d all\ndefault all d\n"
    )
    st = m.statements[0]
    assert st.outputs == [("a b", False), ("c", True)]
    assert st.inputs == [("x", "explicit"), ("y:z", "explicit"), ("h", "implicit"), ("o", "order_only")]
    assert st.validations == ["t"]
    assert st.binding("command") == "cc -O top -o 'a b' x 'y:z' own"
    assert m.statements[1].binding("command") == "cc  -o d 'a b' top"
    assert st.binding("restat") == "0"  # not empty, so it holds
    assert m.statements[2].inputs == [("d", "explicit")]
    assert "names itself" in m.warnings[0]
    assert m.defaults == ["all", "d"]
    assert unparse(m.rules[1].templates["description"]) == "CC ${out} $"
    assert serialize([("text", "a"), ("var", "b")]) == "[a][$b]"


def test_scopes_and_includes():
    m = parse("a = 1\ninclude inc\nsubninja sub\nbuild z: r\n", inc="a = 2\nrule r\n  command = r $a\n", sub="a = 3\nrule r\n  command = s $a\nbuild y: r\n")
    assert [s.binding("command") for s in m.statements] == ["s 3", "r 2"]
    assert [x.parent.number if x.parent else None for x in m.scopes] == [None, 0]
    # Without bindings of its own a statement's scope is the enclosing one, whose variables come before the rule's.
    assert parse("command = top\nrule r\n  command = rule\nbuild a: r\n").statements[0].binding("command") == "top"


def test_rule_variables_in_a_circle():
    m = parse("rule r\n  command = $depfile\n  depfile = $command\n")
    with pytest.raises(ManifestError, match="cycle in rule variables: command -> depfile -> command"):
        Statement(0, m.rules[1], m.root).binding("command")


def test_many_trees(spark):
    trees = spark.createDataFrame([("one", CAT + "build a: cat b\n"), ("two", "x"), ("none", None)], "tree string, text string")
    got = parse_many(trees).cache()
    assert {r.tree: r.error is None for r in got.collect()} == {"one": True, "two": False, "none": True}
    assert [tuple(r) for r in relation(got, "edge_inputs").collect()] == [("one", 0, 0, "b", "explicit")]


@pytest.mark.parametrize(
    ("text", "outs", "ins"),
    [
        ("build/n.o: n.cc n.h e.h\n", ["build/n.o"], ["n.cc", "n.h", "e.h"]), ("foo.o: \\\n  bar.h \\\n  baz.h\n", ["foo.o"], ["bar.h", "baz.h"]), ("a\\ b.o: c\\ d.h\n", ["a b.o"], ["c d.h"]),
        ("a: x\\\\ y\n", ["a"], ["x\\\\", "y"]), ("a: b\\#c d$$e\n", ["a"], ["b#c", "d$e"]), ("a: c\\:\\\\foo.h\n", ["a"], ["c:\\\\foo.h"]), ("c:\\a\\b.o: c:\\a\\b.cc\n", ["c:\\a\\b.o"], ["c:\\a\\b.cc"]),
        ("foo\\: bar\n", ["foo\\"], ["bar"]), ("a: b b c\n", ["a"], ["b", "c"]), ("a b: c\n", ["a", "b"], ["c"]), ("a: b\nc: d\n", ["a", "c"], ["b", "d"]), ("", [], []), ("\n", [], []),
        ("a.o: a.c\r\nb.o: b.c\r\n", ["a.o", "b.o"], ["a.c", "b.c"]), ("a.o: a.c", ["a.o"], ["a.c"]),
    ],
)
def test_depfile(text, outs, ins):
    assert depfile.parse(text.encode()) == (outs, ins)


def test_depfile_errors(spark):
    with pytest.raises(ValueError, match="expected ':' in depfile"):
        depfile.parse(b"foo.o foo.c\n")
    with pytest.raises(ValueError, match="inputs may not also have inputs"):
        depfile.parse(b"a: b\nb: c\nc: d\na: b\nb: e\n")
    rows = spark.createDataFrame([("a: b",), ("x",), (None,)], "t string")
    got = [r.d for r in rows.select(depfile.parse_depfile(rows.t).alias("d")).collect()]
    assert [(x.outs, x.ins, x.error) for x in got] == [(["a"], ["b"], None), ([], [], "expected ':' in depfile"), ([], [], None)]


def test_dyndep():
    m = parse(CAT + "build a: cat x || dd\n  dyndep = dd\nbuild b: cat y || dd\n  dyndep = dd\n")
    rows = dyndep.parse(m, "dd", "ninja_dyndep_version = 1\nbuild a | a.imp: dyndep | h\n  restat = 1\nbuild b: dyndep\n")
    assert rows == [(0, True, ["a.imp"], ["h"]), (1, False, [], [])]
    for text, message in (
        ("build a: dyndep\n", "expected 'ninja_dyndep_version = ...'"), ("ninja_dyndep_version = 2\n", "unsupported 'ninja_dyndep_version = 2'"), ("ninja_dyndep_version = 1\nbuild z: dyndep\n", "no build statement exists for 'z'"),
        ("ninja_dyndep_version = 1\nbuild a: dyndep\nbuild a: dyndep\n", "multiple statements for 'a'"), ("ninja_dyndep_version = 1\nbuild a b: dyndep\n", "explicit outputs not supported"),
        ("ninja_dyndep_version = 1\nbuild a: dyndep x\n", "explicit inputs not supported"), ("ninja_dyndep_version = 1\nbuild a: dyndep || x\n", "order-only inputs not supported"),
        ("ninja_dyndep_version = 1\nbuild a: dyndep\n  x = 1\n", "binding is not 'restat'"), ("", "expected 'ninja_dyndep_version = ...'"),
    ):
        with pytest.raises(ManifestError) as e:
            dyndep.parse(m, "dd", text)
        assert message in str(e.value)
    with pytest.raises(ManifestError, match="loading 'dd'"):
        dyndep.parse(m, "dd", None)


def test_build_log(spark, tmp_path):
    path = tmp_path / ".ninja_log"
    path.write_text("# ninja log v7\n1\t5\t100\tout\tAB\n2\t9\tx\tother\t00ff\nbad line\n3\t4\t200\tout\tzz\n")
    log = logs.read_build_log(spark, str(path))
    assert sorted(map(tuple, log.collect())) == [(1, "out", 1, 5, 100, "ab"), (2, "other", 2, 9, 0, "ff"), (4, "out", 3, 4, 200, "0")]
    last = logs.last_entries(log)
    assert sorted(r.line_no for r in last.collect()) == [2, 4]
    assert [r.line for r in logs.build_log_text(last).collect()] == ["# ninja log v7", "2\t9\t0\tother\tff", "3\t4\t200\tout\t0"]
    more = logs.record_command(log, spark.createDataFrame([("n", 1, 2, 3, "f", 0, 0)], "output string, start_ms int, end_ms int, mtime long, hash string, seq int, pos int"))
    assert more.where("output = 'n'").first().line_no == 5
    path.write_text("# ninja log v5\n1\t5\t100\tout\tab\n")
    assert logs.read_build_log(spark, str(path)).count() == 0
    assert logs.read_build_log(spark, str(tmp_path / "none")).count() == 0
    assert [logs.log_state(x) for x in (None, "# ninja log v7", "# ninja log v8", "# ninja log v6", "x")] == ["empty", "ok", "new", "old", "old"]


def test_compaction_is_due(spark):
    rows = [(k, f"o{k % 30}", 0, 0, 0, "0") for k in range(101)]
    due = lambda r: logs.needs_compaction(spark.createDataFrame(r, logs.BUILD_LOG)).first().compact
    assert due(rows)
    assert not due(rows[:100])
    assert not due([(k, f"o{k % 40}", 0, 0, 0, "0") for k in range(101)])


def test_deps_log(spark, tmp_path):
    records = [("out", 5, ["a", "bcd"]), ("out", 5, ["a", "bcd"]), ("two", 1 << 40, []), ("out", 6, ["a"])]
    raw = logs.encode_deps(records)
    got, paths, warning = logs.decode_deps(raw)
    assert paths == ["out", "a", "bcd", "two"]
    assert [(paths[o], m, [paths[i] for i in ins]) for _, o, m, ins in got] == [("out", 5, ["a", "bcd"]), ("two", 1 << 40, []), ("out", 6, ["a"])]
    assert warning is None
    cut, _, warning = logs.decode_deps(raw[:-3])
    assert len(cut) == 2
    assert "recovering" in warning
    assert logs.decode_deps(b"nonsense")[2].startswith("bad deps log")
    path = tmp_path / ".ninja_deps"
    path.write_bytes(raw)
    logs.register(spark)
    by_source = spark.read.format("deps_log").load(str(path))
    assert sorted(map(str, by_source.collect())) == sorted(map(str, logs.read_deps_log(spark, str(path)).collect()))
    last = logs.last_deps(by_source)
    assert sorted((r.output, r.mtime, r.input) for r in last.collect() if r.input) == [("out", 6, "a")]
    new = spark.createDataFrame([("out", 6, ["a"]), ("two", 2, ["z"])], "output string, mtime long, inputs array<string>")
    assert [(r.output, r.input) for r in logs.record_deps(by_source, new).collect()] == [("two", "z")]
    to = tmp_path / "copy"
    last.coalesce(1).sortWithinPartitions("rec_no", "pos").write.format("deps_log").mode("append").option("path", str(to)).save()
    assert len(logs.decode_deps(to.read_bytes())[0]) == 2


def test_files(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    os.utime(tmp_path / "a", ns=(0, 0))
    snap = files.snapshot(spark, [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "a" / "c")])
    assert [r.mtime for r in snap.collect()] == [1]
    paths = spark.createDataFrame([("a/b/c",), ("d",)], "path string")
    assert sorted(r.path for r in files.parent_folders(paths).collect()) == ["a", "a/b"]
    assert BuildGraph.empty_files(spark).count() == 0
