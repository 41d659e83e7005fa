"""Plans that must not grow faster than their input: how work is dealt out, and what is never read or multiplied."""

import pytest

from quadloom.functions import extract


@pytest.mark.parametrize(
    "text,want",
    [
        ("Title: a b\nsize: 12\nkit:\n  Part:\n    id: p1\ntags:\n  - a\n  - 12\nnone: null\n", {"Title": "a b", "size": 12, "kit": {"Part": {"id": "p1"}}, "tags": ["a", 12], "none": None}),
        ("a: 2024-01-02\nb: 'x # y'\nc: https://x.example/y\nd:\n- 1\n", {"a": "2024-01-02", "b": "x # y", "c": "https://x.example/y", "d": [1]}),
        *((t, None) for t in ("a: 1\na: 2\n", "on: x\n", "a: yes\n", "a: 007\n", "a: b\n  c: d\n", "a: b # c\n", "- a\n", "a:\n  - b: c\n", "a: 1.5\n", "a:\tb\n")),
    ],
)
def test_simple_frontmatter_is_what_yaml_reads(text, want, monkeypatch):
    assert extract.simple_frontmatter(text) == want
    if want is not None:
        monkeypatch.setattr(extract, "simple_frontmatter", lambda text: None)
        assert extract.parse_frontmatter(text) == want


def test_documents_of_one_file_are_dealt_out(spark):
    docs = spark.range(0, 400, 1, 1).selectExpr("concat('d/', id, '.md') AS path", "concat('---\\ntags:\\n  - a\\n---\\n[x](/d/', id, ')') AS content")
    found = extract.facts(docs)
    rows = [len(part) for part in found.rdd.glom().collect()]
    assert sum(rows) == 800 and max(rows) < 400
    joined = extract.facts(docs, docs.select("path"))
    assert joined.where("op = 'linksTo'").count() == 400
    # rows that are no link do not meet under their common value
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [sum(r.subject == "tags" for r in part) for part in extract.facts(docs, docs.select("path")).rdd.glom().collect()]
        assert sum(rows) == 400 and max(rows) < 200
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", keep)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_to_many_is_counted_before_the_join(spark):
    from quadloom.plans.dataset import Dataset, Table
    from quadloom.plans.engine import Engine

    left = spark.range(3000).selectExpr("id AS a", "id % 3 AS a_n", "CAST(id % 4 AS DOUBLE) AS a_v")
    right = spark.range(2000).selectExpr("id AS b", "id % 4 AS b_n", "CAST(id % 5 AS INT) AS b_v")
    e = Engine(Dataset(spark, {"l": Table(left, ("a",)), "r": Table(right, ("b",)), "e": Table(left.where("false").withColumnsRenamed({"a": "z", "a_n": "z_n", "a_v": "z_v"}), ("z",))}))
    text = "SELECT ?n (COUNT(*) AS ?c) (COUNT(?v) AS ?k) (SUM(?v) AS ?s) (SUM(?u) AS ?t) (AVG(?u) AS ?m) (MAX(?v) AS ?x) (COUNT(DISTINCT ?v) AS ?d) WHERE { ?l :a_n ?n ; :a_v ?u . ?r :b_n ?n ; :b_v ?v } GROUP BY ?n"
    got = e.query(text)
    plain = left.join(right, left.a_n == right.b_n).groupBy("a_n").agg({"*": "count", "b_v": "sum", "a_v": "sum"}).collect()
    want = {r["a_n"]: (r["count(1)"], r["count(1)"], r["sum(b_v)"], r["sum(a_v)"], r["sum(a_v)"] / r["count(1)"], 4, 5) for r in plain}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    # no join under the count may hold more rows than its inputs
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join ")
    assert plan.count("Aggregate", join) == 2
    # without a shared variable; an empty side leaves nothing, not a count of nought
    assert e.query("SELECT (COUNT(*) AS ?c) WHERE { ?l :a_n ?n . ?r :b_n ?m }").first().c == 6_000_000
    assert e.query("SELECT ?n (COUNT(*) AS ?c) WHERE { ?l :a_n ?n . ?r :z_n ?m } GROUP BY ?n").count() == 0
    assert e.query("SELECT (COUNT(*) AS ?c) WHERE { ?l :a_n ?n . ?r :z_n ?n }").first().c == 0
    assert e.query("SELECT (COUNT(*) AS ?c) WHERE { ?l :a_n ?n . ?r :b_n ?n FILTER(?n > 0) }").first().c == 1_000_000
    assert e.query("SELECT ?n (SUM(ABS(?v)) AS ?s) WHERE { ?l :a_n ?n . ?r :b_n ?n ; :b_v ?v BIND(STRLEN(STR(?n)) AS ?k) FILTER(ABS(?n) IN (2, 1) && ?k = 1) } GROUP BY ?n").collect()[0].s == 1_000_000


@pytest.mark.parametrize("small", [100_000, 0])
def test_lines_of_one_kit_are_no_single_task(spark, monkeypatch, small):
    from quadloom.operators import resolver

    monkeypatch.setattr(resolver, "SMALL", small)
    k = resolver.Lookups(
        declared=spark.createDataFrame([("kit", "Doc", "size", "u:size", None, False)], "kit string, class string, prop string, iri string, datatype string, is_object boolean"),
        anywhere=spark.createDataFrame([("kit", "free", "u:free", None, False)], "kit string, prop string, iri string, datatype string, is_object boolean"),
        ranges=spark.createDataFrame([], "iri string, range string"),
        kits=spark.createDataFrame([("kit", "u:kit/")], "kit string, namespace string"),
        deprecated=spark.createDataFrame([], "kit string, prop string, replacement string"),
    ).measured()
    assert ("declared" in k.small) == (small > 0)
    lines = spark.range(0, 400, 1, 4).selectExpr("concat('d/', id) AS path", "'kit.doc.size | hasValue | 1' AS line")
    got = resolver.facts(lines, "u:", k)
    assert got.where("p = '<u:size>'").count() == 400 and got.count() == 1200
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [len(part) for part in resolver._lines(lines, "u:", k).rdd.glom().collect()]
        assert sum(rows) == 400 and max(rows) < 300
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def _tables(spark):
    from quadloom.plans.dataset import Dataset, Table

    a = spark.createDataFrame([(1, "x", 2), (2, "https://data.example/b/7", 2)], "a_key int, a_name string, a_b int")
    b = spark.createDataFrame([(2, "two", 1.5), (3, "three", 2.5)], "b_key int, b_name string, b_v double")
    wide = spark.createDataFrame([(9, 4.5)], "w_key int, w_v double")
    return Dataset(spark, {"a": Table(a, ("a_key",), {"a_b": "b"}), "b": Table(b, ("b_key",)), "wide": Table(wide, ("w_key",))})


def _reads(df, column):
    return column in df._jdf.queryExecution().optimizedPlan().toString()


def test_negated_path_reads_what_its_filter_leaves(spark):
    from quadloom.plans.engine import Engine

    e = Engine(_tables(spark))
    text = 'SELECT ?s ?o WHERE { ?s !(:b_name|^:b_v) ?o FILTER(STRSTARTS(STR(?s), "https://data.example/b/")) }'
    got = e.query(text)
    # forward: b's own triples; backward: a link to b and a text that starts so
    want = [("https://data.example/b/2", o) for o in ("2", "1.5", "https://data.example/b", "https://data.example/a/1", "https://data.example/a/2")]
    want += [("https://data.example/b/3", o) for o in ("3", "2.5", "https://data.example/b")] + [("https://data.example/b/7", "https://data.example/a/2")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert not _reads(got, "w_v") and not _reads(got, "w_key")


def test_describe_of_a_known_class_reads_its_table(spark):
    from quadloom.plans.engine import Engine

    got = Engine(_tables(spark)).query('DESCRIBE ?b WHERE { ?a :a_name "x" ; :a_b ?b }')
    assert sorted(r.o for r in got.collect()) == ['"1.5"^^<http://www.w3.org/2001/XMLSchema#double>', '"2"^^<http://www.w3.org/2001/XMLSchema#integer>', '"two"', "<https://data.example/b>"]
    assert not _reads(got, "w_v") and {r.s for r in got.collect()} == {"<https://data.example/b/2>"}
