import random

import pytest
from pyspark.sql import functions as F

from quadloom.functions import extract as X
from quadloom.operators import emit, history, shapes, verify
from quadloom.sources import quads, git, documents
from quadloom.streaming import event_log

EVENTS = "stmt string, op string, ordinal long"


@pytest.mark.parametrize(
    "rows,expected",
    [([("a", "+", 1)], {"a"}), ([("a", "+", 1), ("a", "-", 2)], set()), ([("a", "+", 1), ("a", "-", 2), ("a", "+", 3)], {"a"}), ([("a", "+", 1), ("a", "-", 1)], set()), ([("a", "-", 1)], set()), ([], set()), ([("a", "-", 1), ("b", "+", 1), ("a", "+", 2)], {"a", "b"})],
)
def test_live(spark, rows, expected):
    df = spark.createDataFrame(rows, EVENTS)
    assert {r.stmt for r in history.live(df, ["stmt"]).collect()} == expected


def test_random_histories_agree_with_replay(spark):
    rng, rows, want = random.Random(7), [], set()
    for h in range(120):
        state = set()
        for ordinal in range(1, 7):
            for s in "abcd":
                if rng.random() < 0.3:
                    op = "-" if s in state else "+"
                    (state.discard if op == "-" else state.add)(s)
                    rows.append((f"{h}{s}", op, ordinal))
        want |= {f"{h}{s}" for s in state}
    df = spark.createDataFrame(rows, EVENTS)
    assert {r.stmt for r in history.live(df, ["stmt"]).collect()} == want
    base = history.base_layer(df, ["stmt"])
    assert {r.stmt for r in base.collect()} == want
    assert verify.parity(base, df, ["stmt"]).count() == 0
    changed = df.where("ordinal >= 4")
    assert verify.scoped_parity(base, df, changed, ["stmt"]).count() == 0
    now = history.refresh(history.live(df, ["stmt"], at=3), base, changed, "stmt")
    assert {r.stmt for r in now.collect()} == want


def test_lifespans(spark):
    df = spark.createDataFrame([("a", "+", 1), ("a", "-", 3), ("a", "+", 5), ("b", "+", 2), ("b", "-", 2)], EVENTS)
    assert {tuple(r) for r in history.lifespans(df, ["stmt"]).collect()} == {("a", 1, 3), ("a", 5, None), ("b", 2, 2)}


def test_diff_cancels_moves_and_guard_keeps_what_is_held(spark):
    old = spark.createDataFrame([(1, "x"), (1, "y")], "commit int, stmt string")
    new = spark.createDataFrame([(1, "y"), (1, "z"), (1, "z")], "commit int, stmt string")
    events = history.diff_events(old, new, ["commit", "stmt"])
    assert sorted(map(tuple, events.collect())) == [(1, "x", "-"), (1, "z", "+")]
    assert history.guard_retracts(events, old.where("stmt = 'x'"), ["commit", "stmt"]).count() == 1


def test_malformed_lines(spark):
    lines = ["a | hasValue | x | y", "a | hasValue", "a | likes | x", " | hasValue | x", "", "a | linksTo | ", "a | linksTo | b", "a | hasValue | \x07"]
    got = verify.malformed_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [r.problem for r in got] == ["fields", "operator", "subject", "blank", "empty link", "control character"]


def test_readable(spark):
    rows = [("g1", "me", "private", []), ("g2", "you", "public", []), ("g3", "you", "shared", ["me"]), ("g4", "you", "shared", None), ("g5", "you", "odd", ["me"])]
    df = spark.createDataFrame(rows, "g string, owner string, visibility string, readers array<string>")
    assert [r.g for r in verify.readable(df, "me").orderBy("g").collect()] == ["g1", "g2", "g3"]


def test_shapes(spark):
    facts = spark.createDataFrame([("a", "n", "5"), ("a", "n", "x"), ("b", "n", "50")], "key string, prop string, value string")
    inst = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    got = shapes.validate_facts(inst, facts, [shapes.Constraint("n", required=True, datatype="integer", low=0, high=10)]).collect()
    assert sorted(map(tuple, got)) == [("a", "n", "value"), ("b", "n", "value"), ("c", "n", "count")]
    own = spark.createDataFrame([("Base", "id", "b"), ("Sub", "id", "s"), ("Base", "x", "b")], "class string, prop string, v string")
    anc = spark.createDataFrame([("Sub", "Base", 1)], "class string, ancestor string, depth int")
    assert {tuple(r[c] for c in ("class", "prop", "v")) for r in shapes.inherit(own, anc).collect()} == {("Base", "id", "b"), ("Base", "x", "b"), ("Sub", "id", "s"), ("Sub", "x", "b")}


class TestExtract:
    def test_frontmatter(self):
        assert X.split_frontmatter("---\r\na: 1\r\n---  \r\nbody") == ("a: 1\r\n", "body")
        assert X.split_frontmatter("---\na: 1\n") == (None, "---\na: 1\n")
        assert X.flatten(X.parse_frontmatter("a: 1\nb: [x, 2, null]\nc:\n  d: yes\n  e: 2024-01-02\nf: 1.0")) == [("a", "1"), ("b", "x"), ("b", "2"), ("c.d", "true"), ("c.e", "2024-01-02"), ("f", "1")]
        with pytest.raises(X.DuplicateKeys, match="a, b"):
            X.parse_frontmatter("a: 1\na: 2\nc:\n  b: 1\n  b: 2")
        assert X.one_line("a \n\n b\r\nc") == "a b c"

    @pytest.mark.parametrize("target,folder,want", [("a", "x", "x/a.md"), ("/a.md", "x", "a.md"), ("../a", "x/y", "x/a.md"), ("../../a", "x", None), ("./b/./c.txt", "", "b/c.txt"), ("/", "", None)])
    def test_paths(self, target, folder, want):
        assert X.normalize_path(target, folder) == want

    def test_links(self):
        body = "[a](b%20c.md#x) [w](https://e.org/a_(b)) <http://auto.org> [f](#frag) ![i](pic.png) `[no](x)`\n```\n[no](y)\n```\n[gone](z)"
        assert X.links(body, "d/p.md", lambda p: p == "d/b c.md") == [("linksTo", "d/b c.md"), ("md.externalLink", "https://e.org/a_(b)"), ("md.unresolvedLink", "z"), ("md.externalLink", "http://auto.org")]
        assert X.percent_decode("a%zz%20+%C3%A9") == "a%zz +é"

    def test_facts(self, spark):
        docs = spark.createDataFrame([("a.md", "---\nt: x\n---\n[l](b)"), ("c.md", "---\nt: 1\nt: 2\n---\n"), ("d.md", None)], "path string, content string")
        got = {tuple(r)[:4] for r in X.facts(docs).collect()}
        assert got == {("a.md", "t", "hasValue", "x"), ("a.md", "a.md", "linksTo", "b.md"), ("c.md", None, None, None)}

    def test_split_values(self, spark):
        df = spark.createDataFrame([("a, b,,c",), ("http://x/a,b, https://y",), ("",)], "v string").select(X.split_values(F.col("v")).alias("x"))
        assert [r.x for r in df.collect()] == [["a", "b", "c"], ["http://x/a,b", "https://y"], []]


@pytest.mark.parametrize(
    "value,kind,out",
    [("[[x]]", "error", None), ("@me", "error", None), ("name", "error", None), ("<a/b c>", "iri", "u:a/b%20c"), ("<bare>", "error", None), ("<>", "error", None), ("<http://x/%20>", "iri", "http://x/%20"), ("https://x/y", "iri", "https://x/y"), ("/d/e", "iri", "u:File/d/e"), ("n.md", "iri", "u:File/n.md"), (" ", "literal", "")],
)
def test_references(spark, value, kind, out):
    r = spark.createDataFrame([(value,)], "v string").select(emit.resolve_value(F.col("v"), "u:").alias("r")).first().r
    assert (r.kind, r.value) == (kind, out)


def test_emit(spark):
    lines = spark.createDataFrame([("d/n.md", "kit.Note.id", "hasValue", "7"), ("d/n.md", "kit.Note.title", "hasValue", 'a "b"'), ("d/n.md", "d/n.md", "linksTo", "m.md"), ("d/n.md", "kit.Note.of", "hasValue", "<x/y>, z.md"), ("m.md", "free", "hasValue", "v")], "path string, subject string, op string, object string")
    props = spark.createDataFrame([("kit.Note.id", "k:id", None, False), ("kit.Note.title", "k:title", "u#string", False), ("kit.Note.of", "k:of", None, True)], "key string, iri string, datatype string, is_object boolean")
    got = {(r.s, r.p, r.o) for r in emit.emit(lines, "u:", props).collect()}
    assert ("<u:Note/7>", "<k:title>", '"a \\"b\\""') in got and ("<u:Note/7>", "<u:fileId>", "<u:File/d/n.md>") in got
    assert ("<u:Note/7>", "<k:of>", "<u:x/y>") in got and ("<u:Note/7>", "<k:of>", "<u:File/z.md>") in got
    assert ("<u:File/m.md>", "<u:fm/free>", '"v"') in got and ("<u:File/d/n.md>", "<u:md/linksTo>", "<u:File/m.md>") in got


def test_suggest(spark):
    keys, known = (spark.createDataFrame([(x,) for x in xs], "key string") for xs in (["titl", "Title", "zzzz"], ["title", "subtitle"]))
    assert {r.key: r.suggestions for r in emit.suggest(keys, known).collect()} == {"titl": ["subtitle", "title"], "Title": ["subtitle", "title"], "zzzz": []}


def test_nquads_and_sinks(spark, tmp_path):
    (tmp_path / "x.nq").write_text('<a> <p> "x \\" y"@en <g> .\n# note\n_:b <p> <c> .\nbroken\n<a> <p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .\n')
    df = quads.read_nquads(spark, str(tmp_path / "x.nq"))
    assert df.where("line IS NULL").count() == 3 and df.where("line IS NOT NULL").first().line == "broken"
    good = df.where("line IS NULL")
    quads.write_nquads(good.select("s", "p", "o", "g"), str(tmp_path / "out"))
    again = quads.read_nquads(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, good.collect()))
    json = [r.binding for r in quads.results_json(good.select("s", "o")).collect()]
    assert '"xml:lang":"en"' in json[0] and '"type":"bnode"' in json[1] and "XMLSchema#integer" in json[2]
    assert [tuple(r) for r in quads.spine(good, {"x": "a"}).collect()][0][0] == "x:"
    quads.write_versioned(good, str(tmp_path / "v"), "1")
    (tmp_path / "v" / "version=2").mkdir()
    assert quads.latest(spark, str(tmp_path / "v")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(str(rng.randrange(40)), rng.choice("+-"), n) for n in range(300)]
    df = spark.createDataFrame(rows, EVENTS)
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    event_log.maintain(stream, str(tmp_path / "state"), str(tmp_path / "cp"), ["stmt"]).awaitTermination()
    assert {r.stmt for r in event_log.current(spark, str(tmp_path / "state"), ["stmt"]).collect()} == {r.stmt for r in history.live(df, ["stmt"]).collect()}


def test_git_touched_follows_merged_branches(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for branch, name, text in ((None, "a", "one"), ("side", "b", "two"), ("side", "b", "three"), ("main", "c", "four")):
        if branch:
            run("checkout", "-q", *(["-b"] if branch == "side" and text == "two" else []), branch)
        (tmp_path / name).write_text(text)
        run("add", "."), run("commit", "-qm", text)
    run("merge", "-q", "--no-ff", "-m", "merge", "side")
    summary = {r.commit: r.summary for r in git.commits(spark, str(tmp_path)).collect()}
    got = sorted((summary[r.commit], r.status, r.path) for r in git.touched(spark, str(tmp_path)).collect())
    assert got == [("four", "A", "c"), ("merge", "A", "b"), ("one", "A", "a"), ("three", "M", "b"), ("two", "A", "b")]


def test_git_and_documents(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.md").write_text("one\n" * 9)
    run("add", "."), run("commit", "-qm", "first"), run("tag", "-am", "t", "v1")
    (tmp_path / "a.md").rename(tmp_path / "b c.md")
    (tmp_path / "__t.md").write_text("x"), (tmp_path / ".h").mkdir(), (tmp_path / ".h" / "y.md").write_text("y")
    run("add", "."), run("commit", "-qm", "second")
    c = git.commits(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.summary) for r in c] == [(1, "first"), (2, "second")] and c[1].parents == [c[0].commit]
    assert {(r.kind, r.target) for r in git.refs(spark, str(tmp_path)).collect()} >= {("Tag", c[0].commit)}
    assert ("R", "b c.md", "a.md") in {(r.status, r.path, r.old_path) for r in git.touched(spark, str(tmp_path)).collect()}
    assert git.tree(spark, str(tmp_path)).count() == 3
    assert [r.path for r in documents.read_documents(spark, str(tmp_path)).collect()] == ["b c.md"]
