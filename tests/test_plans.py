import pytest
from pyspark.sql import Row

from quadloom.plans.dataset import Dataset, star_schema
from quadloom.plans.engine import Engine
from quadloom.plans.params import ParameterError, bind, declare
from quadloom.plans.parser import ParseError, parse
from quadloom.plans.planner import Planner, Unsupported

SF = "/root/testdata/sf0.001"
P = {"": "https://data.example/"}


def quads(spark, *rows):
    return Dataset(spark, {}, spark.createDataFrame([Row(s=s, p=p, o=o, g=g) for s, p, o, g in rows], "s string, p string, o string, g string"))


def i(x):
    return f"<https://data.example/{x}>"


def test_star_is_one_scan_with_pushed_filters(spark):
    e = Engine(star_schema(spark, SF))
    df = e.query('SELECT ?p WHERE { ?o a :orders ; :o_orderstatus "F" ; :o_totalprice ?p ; :o_custkey ?c }')
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Join" not in plan and "EqualTo(o_orderstatus,F)" in plan and "o_orderdate" not in plan


def test_unbound_is_compatible(spark):
    d = quads(spark, (i("a"), i("p"), i("x"), None), (i("b"), i("q"), '"1"', None), (i("a"), i("r"), i("y"), None))
    rows = Engine(d).query("SELECT ?s ?v ?w { ?s :p ?v OPTIONAL { ?s :none ?w } OPTIONAL { ?s :r ?w } }").collect()
    assert [(r.v, r.w) for r in rows] == [("https://data.example/x", "https://data.example/y")]


def test_minus_and_not_exists_differ_without_shared_variables(spark):
    d = quads(spark, (i("a"), i("p"), i("x"), None))
    e = Engine(d)
    assert e.query("SELECT ?s { ?s :p ?v MINUS { ?t :p ?u } }").count() == 1
    assert e.query("SELECT ?s { ?s :p ?v FILTER NOT EXISTS { ?t :p ?u } }").count() == 0


def test_default_graph(spark):
    rows = [(i("a"), i("p"), i("x"), i("g1")), (i("a"), i("p"), i("x"), i("g2")), (i("b"), i("p"), i("x"), i("old"))]
    d = quads(spark, *rows)
    assert Engine(d).query("SELECT ?s { ?s :p ?o }").count() == 2
    d.catalog = {"https://data.example/g1": "CurrentGraph"}
    assert Engine(d).query("SELECT ?s { ?s :p ?o }").count() == 1
    assert Engine(d).query("SELECT ?s { GRAPH ?g { ?s :p ?o } }").count() == 3


def test_errors_drop_rows_and_leave_bindings_unbound(spark):
    d = quads(spark, (i("a"), i("p"), '"x"', None), (i("b"), i("p"), '"3"^^<http://www.w3.org/2001/XMLSchema#integer>', None))
    e = Engine(d)
    assert e.query("SELECT ?s { ?s :p ?v FILTER(?v > 1) }").count() == 1
    assert sorted(str(r.n) for r in e.query("SELECT ?n { ?s :p ?v BIND(?v + 1 AS ?n) }").collect()) == ["4.0", "None"]


def test_literal_text_round_trip(spark):
    d = quads(spark, (i("a"), i("p"), '"a\\\\n\\"b\\n"', None))
    assert Engine(d).query("SELECT (STR(?v) AS ?t) { ?s :p ?v }").first().t == 'a\\n"b\n'


def test_service_and_unknown_forms_are_refused(spark):
    d = quads(spark, (i("a"), i("p"), i("x"), None))
    with pytest.raises(Unsupported):
        Engine(d).query("SELECT * { SERVICE <http://x/> { ?s ?p ?o } }")
    with pytest.raises(ParseError):
        Engine(d).query("INSERT DATA { :a :b :c }")
    with pytest.raises(ParseError, match="known prefixes"):
        Engine(d).query("SELECT * { ?s nope:x ?o }")


class TestParameters:
    def test_injection(self, spark):
        d = quads(spark, (i("a"), i("p"), '"x"', None))
        text = '"} UNION { ?s ?p ?o'
        assert Engine(d).query("SELECT ?s { ?s :p ?v }", ["v"], v=text).count() == 0
        assert Engine(d).query("SELECT ?s ?v { ?s :p ?v }", ["v"], v="x").first().v == "x"

    @pytest.mark.parametrize("text,bad", [("integer", "1.5"), ("date", "2024-13-01"), ("boolean", "yes"), ("iri", "no iri"), ("decimal", "x")])
    def test_kinds(self, text, bad):
        q = parse("SELECT ?s { ?s ?p ?x }", P)
        with pytest.raises(ParameterError):
            bind(q, [declare(f"x:{text}")], {"x": bad})

    @pytest.mark.parametrize(
        "query,given",
        [("SELECT ?s { ?s ?x ?o }", {"x": "lit"}), ("SELECT ?s { ?s ?p ?o }", {"x": "a"}), ("SELECT ?s { ?s ?p ?o BIND(1 AS ?x) }", {"x": "a"}), ("SELECT ?s { ?s ?p ?x }", {}), ("SELECT ?s { ?s ?p ?x }", {"x": "a", "y": "b"}), ("SELECT ?s { GRAPH ?x { ?s ?p ?o } }", {"x": "a"})],
    )
    def test_refusals(self, query, given):
        with pytest.raises(ParameterError):
            bind(parse(query, P), [declare("x")], given)

    def test_reaches_every_place(self, spark):
        d = quads(spark, (i("a"), i("p"), '"x"', None), (i("b"), i("p"), '"y"', None))
        q = "SELECT ?s ?w { ?s :p ?w OPTIONAL { ?s :p ?z FILTER(?z = ?v) } { SELECT ?s { ?s :p ?v } } FILTER NOT EXISTS { ?s :q ?v } }"
        assert Planner(d).run(bind(parse(q, P), [declare("v")], {"v": "x"})).count() == 1


def test_saved_queries(spark):
    e = Engine(quads(spark, (i("a"), i("p"), '"x"', None)))
    e.save("one/all", "---\ntitle: t\n---\ntext\n```sparql\nSELECT ?s { ?s ?p ?o }\n```\nmore\n```\nno\n```\n")
    e.save("two/all", "```\nSELECT ?o { ?s ?p ?o }")
    assert e.run_saved("one/all").columns == ["s"]
    with pytest.raises(KeyError, match="ambiguous"):
        e.lookup("all")
    with pytest.raises(ValueError):
        e.save("three", "no block")
