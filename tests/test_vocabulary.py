"""Turtle, sidecars, the graph catalogue and canonical queries on small hand-made rows."""

import json
import subprocess

import pytest

from quadloom.functions import extract
from quadloom.operators import catalog, resolver, shapes, sidecar, vocabulary
from quadloom.plans.canonical import derived_property, one_line, refuse_old_address
from quadloom.plans.engine import PREFIXES
from quadloom.sources import git
from quadloom.sources.quads import results_document, table_text
from quadloom.sources.turtle import TurtleError, parse_turtle, read_turtle

KIT = """
@prefix : <http://k.example/kit/> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
# a kit
:Thing a owl:Class . :Note a owl:Class ; rdfs:subClassOf :Thing, [ a owl:Restriction ; owl:onProperty :title ; owl:cardinality 1 ] .
:title a owl:DatatypeProperty ; rdfs:domain :Note ; rdfs:range xsd:string ; rdfs:comment "its \\"title\\""@en .
:rank a owl:DatatypeProperty ; rdfs:domain :Note ; rdfs:range [ owl:oneOf ( 'low' "high" ) ] .
:old a owl:Class ; owl:deprecated true .
"""


def test_turtle():
    got = parse_turtle(KIT)
    assert ("<http://k.example/kit/title>", "<http://www.w3.org/2000/01/rdf-schema#comment>", '"its \\"title\\""@en') in got
    assert len([t for t in got if t[1].endswith("#first>")]) == 2 and len(got) == len(set(got))
    long = parse_turtle('<s> <p> """a "quoted"\nline""" , 1.5, -2, 1e3, true .', "http://b.example/")
    assert [o for _, _, o in long][0] == '"a \\"quoted\\"\\nline"' and long[0][0] == "<http://b.example/s>" and len(long) == 5
    with pytest.raises(TurtleError, match="line 2"):
        parse_turtle("<s> <p> <o> .\n<s> nope:x <o> .")


def test_vocabulary(spark):
    t = read_turtle(spark, KIT).select("s", "p", "o")
    assert {r["class"] for r in vocabulary.classes(t, "http://k.example/kit/").collect()} == {"<http://k.example/kit/Thing>", "<http://k.example/kit/Note>"}
    rules = {c.prop: c for c in vocabulary.constraints(t, "<http://k.example/kit/Note>")}
    assert rules["title"].required and rules["title"].datatype == "string" and rules["rank"].values == ("low", "high") and not rules["rank"].required
    assert vocabulary.find_class(t, "nOTE") == "<http://k.example/kit/Note>"
    with pytest.raises(KeyError, match="no such"):
        vocabulary.find_class(t, "old")
    loop = spark.createDataFrame([("_:a", vocabulary.FIRST, '"1"'), ("_:a", vocabulary.REST, "_:b"), ("_:b", vocabulary.FIRST, '"2"'), ("_:b", vocabulary.REST, "_:a")], "s string, p string, o string")
    heads = spark.createDataFrame([("_:a",)], "cell string")
    assert [(r.pos, r.item) for r in vocabulary.list_items(loop, heads).orderBy("pos").collect()] == [(0, '"1"'), (1, '"2"')]


def test_sidecars_stop_at_what_is_wrong(spark):
    props = spark.createDataFrame([], "key string, iri string, datatype string, is_object boolean")
    for line in (None, "a | b", "a | runs | c"):
        with pytest.raises(ValueError):
            sidecar.resolve(spark.createDataFrame([("x.md", line)], "path string, line string"), "http://b/", props)
    assert sidecar.resolve(spark.createDataFrame([], "path string, line string"), "http://b/", props).count() == 0


def test_catalog_and_manifest(spark):
    assert catalog.upsert_manifest({"mine": 1, "theirs": 2, "gone": 3}, {"mine": 5, "other": 6}, {"mine", "gone"}) == {"mine": 5, "theirs": 2}
    triples, warnings = catalog.config_triples({"name": "n", "tags": ["a", "b"], "odd": 1}, "http://b/repo", "http://b/", {"name", "tags"})
    assert len(triples) == 3 and warnings == ["unknown key 'odd'"]
    one, none = spark.createDataFrame([(3, "g")], "ordinal long, graph string"), spark.createDataFrame([], "commit string")
    assert catalog.may_skip(3, one, one, "g", one, True, none) and not catalog.may_skip(4, one, one, "g", one, True, none)


def test_canonical_queries():
    text = "select ?s # all\nwhere {\n ?s a owl:Class .\n}"
    line = one_line(text, PREFIXES)
    assert "\n" not in line and line == one_line(line, PREFIXES) and "#" not in line.replace("owl#", "")
    assert derived_property(f"---\nsparql: x\n---\n```\n{text}\n```\n", PREFIXES) == line and derived_property("```\nnot a query\n```", PREFIXES) is None
    refuse_old_address("SELECT ?s { ?s ?p <https://root.example/mine/x> }", "https://root.example/", "https://root.example/mine/")
    with pytest.raises(ValueError, match="<other/x>"):
        refuse_old_address("SELECT ?s { ?s ?p <https://root.example/other/x> }", "https://root.example/", "https://root.example/mine/")


def test_result_documents(spark):
    rows = spark.createDataFrame([("<http://a/x>", '"v"@en')], "x string, y string")
    found = json.loads(results_document(rows))
    assert found["head"]["vars"] == ["x", "y"] and found["results"]["bindings"][0]["x"] == {"type": "uri", "value": "http://a/x"}
    assert table_text(rows).splitlines()[0].startswith("x ") and table_text(rows.where("false")) == "(No results found)"


def _of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_resolver(spark):
    props = "kit string, class string, prop string, iri string, datatype string, is_object boolean"
    k = resolver.Lookups(
        _of(spark, [("k", "Note", "of", "u:ontology/k/of", None, True), ("k", "Note", "noteId", "u:ontology/k/noteId", None, False)], props),
        _of(spark, [], "kit string, prop string, iri string, datatype string, is_object boolean"),
        _of(spark, [("u:ontology/k/of", "nowhere")], "iri string, range string"),
        _of(spark, [("k", "u:ontology/k/")], "kit string, namespace string"),
        _of(spark, [], "kit string, prop string, replacement string"),
    )
    lines = [
        ("a.md", "k.Note.id | hasValue | <k/Other/x y>"), ("a.md", "k.Note.noteId | hasValue | 1"), ("a.md", "k.Other.t | hasValue | v"),
        ("b.md", "k.note.noteId | hasValue | 2"), ("b.md", "k.Note.of | hasValue | z"), ("b.md", "no line"), ("b.md", "e | hasValue |  "),
        ("c.md", "k.Note.id | hasValue | not an address"), ("d.md", "see-link | hasValue | x/y.md"), ("d.md", "see-link | hasValue | x/y.md"), (None, "f | hasValue | 1"),
    ]
    df = _of(spark, lines, "path string, line string")
    got = {tuple(r) for r in resolver.facts(df, "u:", k).collect()}
    facts = {(s, p, o) for _, s, p, o, e in got if e is None}
    # the address wins: the document's thing is the other class's, and the keys of its own class are about the file
    assert ("<u:k/Other/x%20y>", "<u:ontology/k/t>", '"v"') in facts and ("<u:File/a.md>", "<u:ontology/k/noteId>", '"1"') in facts
    assert ("<u:k/Other/x%20y>", "<u:fileId>", "<u:File/a.md>") in facts and ("<u:k/Other/x%20y>", resolver.RDF_TYPE, "<u:ontology/k/Other>") in facts
    assert any(s.endswith("Note/2>") and p == "<u:ontology/k/noteId>" for s, p, _ in facts if s)
    assert ("b.md", None, None, None, "range is no class") in got
    assert ("<u:File/c.md>", resolver.RDF_TYPE, "<u:ontology/k/Note>") in facts and not any(o == "<u:File/c.md>" for *_, o in facts)
    assert ("<u:File/d.md>", "<u:fm/see-link>", "<u:File/x/y.md>") in facts
    assert resolver.facts(df.limit(0), "u:", k).count() == 0
    assert {(r.prop, r.note) for r in resolver.key_notes(df, "u:", k).collect()} == {("id", "unknown"), ("t", "unknown")}


def test_facts_of_links(spark):
    docs = _of(spark, [("a/b.md", "[x](c.md) [y](../d) [z](../../e) ![i](c.md)"), ("a/c.md", None)], "path string, content string")
    got = {tuple(r)[1:4] for r in extract.facts(docs, docs).collect()}
    assert got == {("a/b.md", "linksTo", "a/c.md"), ("md.unresolvedLink", "hasValue", "../d"), ("md.unresolvedLink", "hasValue", "../../e")}
    got = {tuple(r)[1:4] for r in extract.facts(docs, _of(spark, [("d.md",)], "path string")).collect()}
    assert ("a/b.md", "linksTo", "d.md") in got and ("md.unresolvedLink", "hasValue", "c.md") in got


def test_inherit_equivalents(spark):
    own = _of(spark, [("Base", "name", "b"), ("Sub", "label", "s"), ("Base", "x", "b")], "class string, prop string, v string")
    up = _of(spark, [("Sub", "Base", 1)], "class string, ancestor string, depth int")
    same = _of(spark, [("name", "n"), ("label", "n")], "prop string, set string")
    got = {(r["class"], r["prop"], r["v"]) for r in shapes.inherit(own, up, same).collect()}
    assert got == {("Base", "name", "b"), ("Base", "x", "b"), ("Sub", "label", "s"), ("Sub", "x", "b")}


def test_git_ranges_blobs_and_ignore_rules(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    (tmp_path / "out").mkdir()
    for name, text in ((".gitignore", "out/\n*.log.md\n"), ("a.md", "x"), ("b.md", "x"), ("out/c.md", "y"), ("d.log.md", "z")):
        (tmp_path / name).write_text(text)
    run("add", "."), run("commit", "-qm", "one")
    first = run("rev-parse", "HEAD")
    (tmp_path / "a.md").write_text("w")
    run("commit", "-qam", "two")
    assert [(r.ordinal, r.summary) for r in git.commits(spark, str(tmp_path), after=first, last=1).collect()] == [(2, "two")]
    assert git.commits(spark, str(tmp_path), after="HEAD").count() == 0
    files = git.tree(spark, str(tmp_path), first)
    assert files.count() == 3 and git.blobs(files).count() == 2
    docs = _of(spark, [("a.md", 1), ("out/c.md", 2), ("out/deep/e.md", 3), ("d.log.md", 4), ("outer/f.md", 5), (None, 6)], "path string, n int")
    assert sorted(r.n for r in git.not_ignored(docs, git.ignored(spark, str(tmp_path))).collect()) == [1, 5, 6]
