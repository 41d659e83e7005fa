"""Queries through vocabularies, sidecars, the graph catalogue and stored quads, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import extract
from .operators import catalog, history, resolver, shapes, sidecar, verify, vocabulary
from .operators.emit import emit, resolve_value
from .plans.dataset import BASE, Dataset, star_schema
from .plans.engine import Engine
from .sources.turtle import read_turtle

OWL, RDFS, XSD = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2001/XMLSchema#"
_D = f"'{BASE}'"


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _iri(kind, key):
    return F.concat(F.lit(f"<{BASE}{kind}/"), key.cast("string"), F.lit(">"))


def _quads(df, *columns):
    """Stored quads of (s, p, o) given as columns."""
    return df.select(*(c.alias(n) for c, n in zip(columns, ("s", "p", "o"))), F.lit(None).cast("string").alias("g"))


def mixed_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate that a table has and stored quads have as well."""
    d = star_schema(spark, sf_dir)
    extra = _quads(_read(spark, sf_dir, "nation"), _iri("region", F.col("n_nationkey") + 90), F.lit(f"<{BASE}r_name>"), F.concat(F.lit('"extra '), "n_name", F.lit('"')))
    return Engine(Dataset(spark, {k: d.tables[k] for k in ("region", "nation")}, extra)).query("SELECT ?r ?n WHERE { ?r :r_name ?n }")


def exists_in_or(spark, sf_dir):
    return Engine(star_schema(spark, sf_dir)).query(
        "SELECT ?c ?b WHERE { ?c :c_acctbal ?b ; :c_nationkey ?n FILTER(EXISTS { ?s :s_nationkey ?m ; :s_acctbal ?x FILTER(?m = ?n && ?x > ?b) } || ?b > 9000) }"
    )


def path_zero_absent(spark, sf_dir):
    return Engine(star_schema(spark, sf_dir)).query("SELECT ?y WHERE { :absent :n_regionkey* ?y }")


def path_chain(spark, sf_dir):
    """All that one end of a chain as long as the customer table reaches."""
    c = _read(spark, sf_dir, "customer")
    links = _quads(c, _iri("customer", F.col("c_custkey")), F.lit(f"<{BASE}next>"), _iri("customer", F.col("c_custkey") + 1))
    return Engine(Dataset(spark, {}, links)).query("SELECT ?y WHERE { <https://data.example/customer/1> :next+ ?y }")


def sum_error(spark, sf_dir):
    """A sum over a value that is no number is unbound; groups of numbers alone are not."""
    e = _read(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 100 == 0, F.lit('"x"')).otherwise(F.concat(F.lit('"'), (F.col("event_id") % 7).cast("string"), F.lit(f'"^^<{XSD}integer>')))
    q = _quads(e, _iri("event", F.col("event_id")), F.lit(f"<{BASE}v>"), value).unionByName(_quads(e, _iri("event", F.col("event_id")), F.lit(f"<{BASE}of>"), F.concat(F.lit('"'), (F.col("event_id") % 10).cast("string"), F.lit('"'))))
    return Engine(Dataset(spark, {}, q)).query("SELECT ?k (SUM(?v) AS ?total) WHERE { ?e :of ?k ; :v ?v } GROUP BY ?k")


def term_functions(spark, sf_dir):
    return Engine(star_schema(spark, sf_dir)).query(
        'SELECT ?n (DATATYPE(?k) AS ?dt) (LANG(?n) AS ?l) (SHA1(?n) AS ?h) (BOUND(?z) AS ?b) (STR(STRDT(?n, xsd:string)) AS ?t) WHERE { ?x :n_name ?n ; :n_nationkey ?k OPTIONAL { ?x :r_name ?z } }'
    )


def time_parts(spark, sf_dir):
    return Engine(star_schema(spark, sf_dir)).query("SELECT ?e (HOURS(?t) AS ?h) (MINUTES(?t) AS ?m) (DAY(?t) AS ?d) WHERE { ?e a :events ; :ts ?t }")


def grouped_count_ordered(spark, sf_dir):
    return Engine(star_schema(spark, sf_dir)).query("SELECT ?s (COUNT(?o) AS ?n) WHERE { ?o :o_orderstatus ?s } GROUP BY ?s ORDER BY DESC(?n)")


# vocabularies: a class for each nation below one for its region, a property for each part
def _vocabulary(spark, sf_dir):
    n, p = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "part")
    rdf_type, cls = vocabulary.TYPE, _iri("kit/Nation", F.col("n_nationkey"))
    prop = _iri("kit/part", F.col("p_partkey"))
    own = _iri("kit/Nation", F.col("p_partkey") % 25)
    cell = lambda i: F.concat(F.lit("_:c"), "p_partkey", F.lit(f"x{i}"))
    name = lambda k: F.lit(f"<{k}>")
    number = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit(f'"^^<{XSD}integer>'))
    restriction = F.concat(F.lit("_:r"), "p_partkey")
    sized = _iri("kit/size", F.col("p_partkey"))
    rows = [
        _quads(n, cls, F.lit(rdf_type), name(OWL + "Class")),
        _quads(n, cls, name(RDFS + "subClassOf"), _iri("kit/Nation", F.col("n_regionkey"))).where("s <> o"),
        _quads(n.where("n_nationkey % 7 = 3"), cls, name(OWL + "deprecated"), F.lit(f'"true"^^<{XSD}boolean>')),
        _quads(p, prop, F.lit(rdf_type), F.when(F.col("p_size") % 2 == 0, f"<{OWL}DatatypeProperty>").otherwise(f"<{OWL}ObjectProperty>")),
        _quads(p.where("p_partkey % 5 > 0"), prop, name(RDFS + "domain"), own),
        _quads(p.where("p_partkey % 3 = 0"), prop, name(RDFS + "range"), sized),
        _quads(p.where("p_partkey % 11 = 0"), prop, name(OWL + "deprecated"), F.lit(f'"true"^^<{XSD}boolean>')),
        _quads(p, own, name(RDFS + "subClassOf"), restriction),
        _quads(p, restriction, name(OWL + "onProperty"), prop),
        _quads(p.where("p_size % 4 < 2"), restriction, F.when(F.col("p_size") % 4 == 0, f"<{OWL}minCardinality>").otherwise(f"<{OWL}cardinality>"), number(F.col("p_size") % 3)),
        _quads(p.where("p_size % 4 = 2"), restriction, name(OWL + "onClass"), _iri("kit/Nation", F.col("p_size") % 25)),
        _quads(p.where("p_size % 4 = 2"), restriction, F.when(F.col("p_size") % 3 == 0, f"<{OWL}qualifiedCardinality>").otherwise(f"<{OWL}minQualifiedCardinality>"), number(F.col("p_size"))),
        # each size is one of three literals, or an integer within bounds
        _quads(p.where("p_partkey % 2 = 0"), sized, name(OWL + "oneOf"), cell(0)),
        *(_quads(p.where("p_partkey % 2 = 0"), cell(i), F.lit(vocabulary.FIRST), F.concat(F.lit('"'), F.split("p_name", " ").getItem(0), F.lit(f' {9 - i}"'))) for i in range(3)),
        *(_quads(p.where("p_partkey % 2 = 0"), cell(i), F.lit(vocabulary.REST), cell(i + 1) if i < 2 else F.lit(vocabulary.NIL)) for i in range(3)),
        _quads(p.where("p_partkey % 2 = 1"), sized, name(OWL + "onDatatype"), name(XSD + "integer")),
        _quads(p.where("p_partkey % 2 = 1"), sized, name(OWL + "withRestrictions"), cell("b")),
        _quads(p.where("p_partkey % 2 = 1"), cell("b"), F.lit(vocabulary.FIRST), cell("f")),
        _quads(p.where("p_partkey % 2 = 1"), cell("b"), F.lit(vocabulary.REST), cell("b")),
        _quads(p.where("p_partkey % 2 = 1"), cell("f"), name(XSD + "minInclusive"), number(F.col("p_size"))),
        _quads(p.where("p_partkey % 2 = 1"), cell("f"), name(XSD + "maxInclusive"), number(F.col("p_size") + 10)),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("s", "p", "o")


def vocabulary_classes(spark, sf_dir):
    return vocabulary.classes(_vocabulary(spark, sf_dir), f"{BASE}kit/")


def vocabulary_properties(spark, sf_dir):
    return vocabulary.properties(_vocabulary(spark, sf_dir))


def vocabulary_enums(spark, sf_dir):
    return vocabulary.enums(_vocabulary(spark, sf_dir))


def vocabulary_required(spark, sf_dir):
    return vocabulary.required(_vocabulary(spark, sf_dir))


def vocabulary_qualified(spark, sf_dir):
    return vocabulary.qualified(_vocabulary(spark, sf_dir))


def vocabulary_bounded(spark, sf_dir):
    return vocabulary.bounded(_vocabulary(spark, sf_dir))


def vocabulary_domain_open(spark, sf_dir):
    return vocabulary.domain_open(_vocabulary(spark, sf_dir))


def vocabulary_ranges(spark, sf_dir):
    return vocabulary.reference_ranges(_vocabulary(spark, sf_dir))


def vocabulary_compact(spark, sf_dir):
    return vocabulary.compact(_vocabulary(spark, sf_dir), f"{BASE}kit/")


SHAPES = """
@prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix : <https://data.example/> .
:Order a owl:Class ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :o_orderstatus ; owl:minCardinality 1 ] .
:o_orderstatus a owl:DatatypeProperty ; rdfs:domain :Order ; rdfs:range :Status .
:Status a rdfs:Datatype ; owl:oneOf ( "F" "O" ) .
:o_totalprice a owl:DatatypeProperty ; rdfs:domain :Order ; rdfs:range :Price .
:Price a rdfs:Datatype ; owl:onDatatype xsd:double ; owl:withRestrictions ( [ xsd:minInclusive 1000 ] [ xsd:maxInclusive 400000.0 ] ) .
:o_orderpriority a owl:DatatypeProperty ; rdfs:domain :Order ; rdfs:range xsd:integer .
"""


def shape_from_vocabulary(spark, sf_dir):
    rules = vocabulary.constraints(read_turtle(spark, SHAPES).select("s", "p", "o"), f"<{BASE}Order>")
    return shapes.validate_table(_read(spark, sf_dir, "orders"), "o_orderkey", rules)


# documents to history: a document for each supplier and brand, its lines the parts of the brand
def _versions(spark, sf_dir):
    """(ordinal, path, s, p, o): eight commits in which parts join, leave, move between documents and come back."""
    p = _read(spark, sf_dir, "part")
    commits = F.explode(F.sequence(F.lit(1), F.lit(8))).alias("ordinal")
    rows = p.select("p_partkey", "p_size", commits)
    there = (F.col("ordinal") + F.col("p_partkey")) % 5 > 1
    path = F.concat(F.lit("doc/"), ((F.col("p_partkey") + F.when(F.col("ordinal") > 4, 1).otherwise(0)) % 10).cast("string"))
    return rows.where(there).select("ordinal", path.alias("path"), F.col("p_partkey").alias("s"), F.when(F.col("ordinal") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("o"))


def hist_eight_commits(spark, sf_dir):
    return sidecar.version_events(_versions(spark, sf_dir), ["s", "o"])


def hist_event_quads(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    rows = e.select(F.floor(F.col("event_id") / 10).cast("string").alias("commit"), _iri("user", F.col("user_id")).alias("s"), F.lit(f"<{BASE}did>").alias("p"), F.concat(F.lit('"'), "event_type", F.lit('"')).alias("o"), F.when(F.col("event_type") == "view", "-").otherwise("+").alias("op"))
    return sidecar.event_quads(rows, BASE, f"{BASE}graph/history").select("p", F.regexp_replace("o", "^<<.*", "told").alias("o")).groupBy("p", "o").agg(F.count("*").alias("n"))


def sidecar_lines(spark, sf_dir):
    """Lines of the sidecars that commits have, without blanks and comments."""
    c = _read(spark, sf_dir, "customer")
    tree = c.select((F.col("c_custkey") % 4).alias("commit"), F.concat(F.lit("doc/"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_nationkey").alias("blob"))
    blobs = _read(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("blob"), F.concat(F.lit("# made by hand\n\nkit.Nation.name | hasValue | "), "n_name", F.lit("\n")).alias("content"))
    return sidecar.sidecar_at(tree, blobs)


def sidecar_resolved(spark, sf_dir):
    """Facts of sidecar lines: ids, text, references and links."""
    c = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    lines = F.array(
        F.concat(F.lit("kit.Customer.id | hasValue | "), key),
        F.concat(F.lit("kit.Customer.name | hasValue | "), "c_name"),
        F.concat(F.lit("kit.Customer.nation | hasValue | <Nation/"), F.col("c_nationkey").cast("string"), F.lit(">")),
        F.concat(F.lit("body | linksTo | other/"), key, F.lit(".md")),
        F.lit("kit.Customer.note | hasValue | "),
    )
    rows = c.select(F.concat(F.lit("doc/"), key).alias("path"), F.explode(lines).alias("line"))
    props = spark.createDataFrame([("kit.Customer.name", f"{BASE}name", f"{XSD}string", False), ("kit.Customer.nation", f"{BASE}nation", None, True), ("kit.Customer.id", f"{BASE}id", f"{XSD}string", False)], "key string, iri string, datatype string, is_object boolean")
    return sidecar.resolve(rows, BASE, props).select("path", "s", "p", "o")


def sidecar_dropped(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    line = F.when(F.col("p_size") % 4 == 0, F.lit("kit.Part.x | hasValue | ")).when(F.col("p_size") % 4 == 1, F.lit("no fields")).when(F.col("p_size") % 4 == 2, F.lit("a | dances | b")).otherwise(F.concat(F.lit("a | linksTo | "), "p_name"))
    return sidecar.dropped(p.select(line.alias("line")))


def sidecar_changes(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    path = F.concat(F.lit("doc/"), F.col("c_nationkey").cast("string"))
    lines = c.where("c_nationkey < 20").select(path.alias("path"), F.col("c_mktsegment").alias("line"))
    n = _read(spark, sf_dir, "nation").where("n_nationkey > 5")
    stored = n.select(F.concat(F.lit("doc/"), F.col("n_nationkey").cast("string")).alias("path"), F.when(F.col("n_nationkey") % 2 == 0, "AUTOMOBILE\nBUILDING\nFURNITURE\nHOUSEHOLD\nMACHINERY\n").otherwise("old\n").alias("content"))
    return sidecar.sidecar_writes(lines, stored)


def dev_horizon(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    first = e.agg(F.min("ts")).first()[0]
    commits = e.select((F.col("event_id") + 1).alias("ordinal"), F.col("event_id").cast("string").alias("commit"), F.array((F.col("event_id") - 1).cast("string")).alias("parents"), F.col("ts").alias("committer_time"))
    day = (first.date()).isoformat()
    return sidecar.horizon(commits, day).select("ordinal", "base")


def now_only_facts(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    tree = p.select(F.concat(F.lit("parts/"), "p_name", F.lit(".md")).alias("path"), F.when(F.col("p_size") > 10, F.md5("p_name")).alias("blob"))
    return sidecar.now_facts(tree.distinct(), BASE).groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("o").alias("kinds"))


def kit_hints(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    values = o.select(F.concat_ws("/", F.col("o_orderstatus"), F.col("o_custkey").cast("string")).alias("value")).distinct()
    kits = o.select(F.col("o_orderstatus").alias("kit")).distinct()
    paths = spark.createDataFrame([("F/readme.md",)], "path string")
    return sidecar.bare_kit_hints(values, kits, paths)


def old_date_keys(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    key = F.when(F.col("event_type") == "view", "kit.Doc.dateCreated").when(F.col("event_type") == "click", "kit.Doc.dateUpdated").otherwise("kit.Doc.title")
    return sidecar.rename_dates(e.select("event_id", key.alias("subject")), ["createdDate"]).groupBy("subject").agg(F.count("*").alias("n"))


def date_stamps(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    path = F.col("p_partkey").cast("string")
    docs = p.select(path.alias("path"), F.col("p_name").alias("content"))
    stored = p.where("p_partkey % 3 > 0").select(path.alias("path"), F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("\n")))).otherwise(F.lit("was other")).alias("old"), F.lit("2020-01-01").alias("created"), F.lit("2020-01-02").alias("updated"))
    return sidecar.stamp_dates(docs, stored, F.lit("2024-05-05")).select("path", "created", "updated")


def healed_links(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    key = (F.col("c_custkey") % 40).cast("string")
    docs = c.select(F.col("c_custkey").cast("string").alias("path"), F.concat(F.lit("See [a](/doc/"), key, F.lit(".md#top) and [b](other.md).")).alias("content"))
    n = _read(spark, sf_dir, "nation")
    renames = n.select(F.concat(F.lit("doc/"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("old"), F.concat(F.lit("new doc/"), "n_name", F.lit(".md")).alias("new"))
    return sidecar.heal_links(docs, renames)


def doc_typed(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    facts = p.select(F.col("p_partkey").alias("doc"), F.explode(F.array(F.struct(F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value")), F.struct(F.lit("brand").alias("key"), F.col("p_brand").alias("value")), F.struct(F.lit("odd").alias("key"), F.lit(" ").alias("value")), F.struct(F.lit("who").alias("key"), F.col("p_type").alias("value")))).alias("x")).select("doc", "x.*", (F.col("doc") % 50 == 0).alias("nested"))
    props = spark.createDataFrame([("size", "kit/size", "integer"), ("brand", "kit/brand", "integer"), ("odd", "kit/odd", "string")], "key string, iri string, datatype string")
    return sidecar.typed_triples(facts, props)


# the graph catalogue and stored quads
def _graphs(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    g = F.concat(F.lit(f"<{BASE}graph/"), F.when(F.col("event_type") == "view", "history").when(F.col("event_type") == "click", "ontology").otherwise(F.col("event_type")), F.lit(">"))
    return e.select(_iri("user", F.col("user_id")).alias("s"), F.lit(f"<{BASE}did>").alias("p"), F.concat(F.lit('"'), (F.col("event_id") % 100).cast("string"), F.lit('"')).alias("o"), F.when(F.col("event_type") != "error", g).alias("g"))


def graph_descriptions(spark, sf_dir):
    return catalog.describe_graphs(_graphs(spark, sf_dir), BASE, "me", {"history": "HistoryGraph", "ontology": "OntologyGraph"})


def graphs_kept(spark, sf_dir):
    keep = spark.createDataFrame([(f"<{BASE}graph/ontology>",), (f"<{BASE}graph/none>",)], "g string")
    return catalog.keep_graphs(_graphs(spark, sf_dir), keep).groupBy("g").agg(F.count("*").alias("n"))


def quads_updated(spark, sf_dir):
    q = _graphs(spark, sf_dir)
    add = q.where("g IS NULL").withColumn("o", F.lit('"new"'))
    return catalog.update(q, q.where(F.col("g").endswith("history>")), add).groupBy("g").agg(F.count("*").alias("n"))


def quads_reloaded(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    old, new = (e.where(c).select("user_id", "event_type") for c in ("event_id % 3 > 0", "event_id % 3 < 2"))
    return catalog.reload(old, new).groupBy("change", "event_type").agg(F.count("*").alias("n"))


def known_stores(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    entries = c.select(F.concat(F.lit("/home/"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "/").otherwise("")).alias("path"), F.col("c_custkey").alias("last_used"), F.col("c_name").alias("name"))
    here = _read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("/home/"), F.col("n_nationkey").cast("string")).alias("path"))
    return catalog.registry(entries, here)


def shared_names(spark, sf_dir):
    same = spark.createDataFrame([(f"<{BASE}did>", f"<{BASE}has/done>")], "name string, declared string")
    return catalog.equivalents(_graphs(spark, sf_dir), same, [f"<{BASE}graph/ontology>"]).groupBy("p", "g").agg(F.count("*").alias("n"))


def now_view_full(spark, sf_dir):
    """Base facts without those about events."""
    q = _graphs(spark, sf_dir).select("s", "p", "o")
    return history.now_view(q, q.where("o = '\"7\"'").select("s")).groupBy("s").agg(F.count("*").alias("n"))


def resume_after(spark, sf_dir):
    log = _read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("commit"), F.col("event_id").alias("ordinal"))
    return history.resume_point(log, log.where("ordinal % 10 < 7").select("commit"))


def rewound_commits(spark, sf_dir):
    log = _read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("commit"))
    return history.rewound(log, log.where("commit NOT LIKE '%9'"))


def emit_values(spark, sf_dir):
    """How frontmatter values resolve: paths, brackets, web addresses, refusals."""
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    v = F.element_at(F.array(F.concat(F.lit("<a/"), k, F.lit(">")), F.concat(F.lit("docs/"), k, F.lit(".md")), F.concat(F.lit("https://x.example/"), k), F.concat(F.lit("[["), k, F.lit("]]")), F.concat(F.lit("@"), k), k), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select("p_partkey", resolve_value(v, BASE).alias("r")).select("p_partkey", "r.kind", "r.value", "r.error")


def _lookups(spark):
    kit = f"{BASE}ontology/kit/"
    declared = [("kit", "Customer", "name", f"{kit}name", f"{XSD}string", False), ("kit", "Customer", "balance", f"{BASE}ontology/root/balance", f"{XSD}decimal", False), ("kit", "Customer", "nation", f"{kit}nation", None, True), ("kit", "Customer", "seeAlso", f"{kit}seeAlso", None, True), ("kit", "Customer", "customerId", f"{kit}customerId", None, False), ("kit", "Customer", "createdDate", f"{kit}createdDate", f"{XSD}date", False), ("kit", "Nation", "population", f"{kit}population", None, False)]
    frame = spark.createDataFrame
    return resolver.Lookups(
        declared=frame(declared, "kit string, class string, prop string, iri string, datatype string, is_object boolean"),
        anywhere=frame([("kit", "remark", f"{kit}remark", None, False)], "kit string, prop string, iri string, datatype string, is_object boolean"),
        ranges=frame([(f"{kit}nation", f"{kit}Nation"), (f"{kit}seeAlso", f"{BASE}Thing")], "iri string, range string"),
        kits=frame([("kit", kit)], "kit string, namespace string"),
        deprecated=frame([("kit", "segment", "name")], "kit string, prop string, replacement string"),
        things=(f"{BASE}Thing",),
    )


def _customer_lines(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    says = lambda k, *v: F.concat(F.lit(f"{k} | hasValue | "), *v)
    lines = F.array(
        says("kit.customer.customerId", key),
        says("kit.Customer.balance", F.col("c_nationkey").cast("string")),
        says("kit.Customer.nation", F.col("c_nationkey").cast("string"), F.lit(", 7")),
        says("kit.Customer.seeAlso", F.lit("<kit/Nation/1>, bare")),
        says("kit.Customer.dateCreated", F.lit("2024-01-02")),
        says("kit.Customer.remark", F.lit('a "b"')),
        says("kit.Customer.segment", "c_mktsegment"),
        says("kit.Customer.population", F.lit("1")),
        says("kit.Customer.names", F.lit("n")),
        says("kit.Nation.population", F.lit("[[x]]")),
        says("old-links", F.lit("a/b.md, plain")),
        says("md.externalLink", F.lit("https://x.example/")),
    )
    # twelve lines of a row: dealt out before there are so many
    c = c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return c.select(F.concat(F.lit("doc/"), key).alias("path"), F.explode(lines).alias("line"))


def lines_resolved(spark, sf_dir):
    """Sidecar lines by all lookups: declared, domain-open and undeclared keys, ranges, old keys, refusals."""
    return resolver.facts(_customer_lines(spark, sf_dir), BASE, _lookups(spark))


def doc_facts(spark, sf_dir):
    """Frontmatter and links of Markdown documents: every third link leads nowhere."""
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size")
    k = F.col("k").cast("string")
    front = F.concat(F.lit("---\nTitle: "), "p_name", F.lit("\nsize: "), F.col("p_size").cast("string"), F.lit("\nkit:\n  Part:\n    id: p"), k, F.lit("\ntags:\n  - a\n  - "), k, F.lit("\nnone: null\n---\n"))
    to = F.when(F.col("k") % 3 == 0, F.concat(F.lit("../no%20where/"), k)).otherwise(F.concat(F.lit("/doc/"), k, F.lit("#top")))
    body = F.concat(F.lit("See [this]("), to, F.lit(") and <https://x.example/"), k, F.lit(">.\n```\n[code](x.md)\n```\n"))
    docs = p.select(F.concat(F.lit("doc/"), k, F.lit(".md")).alias("path"), F.concat(front, body).alias("content"))
    return extract.facts(docs, docs.select("path")).select("path", "subject", "op", "object")


def keys_noted(spark, sf_dir):
    found = resolver.key_notes(_customer_lines(spark, sf_dir), BASE, _lookups(spark))
    return found.withColumn("names", F.array_join("names", ","))


def malformed_sidecars(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    line = F.element_at(F.array(F.lit("a | hasValue | b"), F.lit("a | b"), F.lit("a | runs | b"), F.lit(" | hasValue | b"), F.lit("a | linksTo |  ")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return verify.malformed_lines(p.select("p_partkey", line.alias("line"))).select("p_partkey", "problem")


_FUNCTIONS = (mixed_dataset, exists_in_or, path_zero_absent, path_chain, sum_error, term_functions, time_parts, grouped_count_ordered, vocabulary_classes, vocabulary_properties, vocabulary_enums, vocabulary_required, vocabulary_qualified, vocabulary_bounded, vocabulary_domain_open, vocabulary_ranges, vocabulary_compact, shape_from_vocabulary, hist_eight_commits, hist_event_quads, sidecar_lines, sidecar_resolved, sidecar_dropped, sidecar_changes, dev_horizon, now_only_facts, kit_hints, old_date_keys, date_stamps, healed_links, doc_typed, graph_descriptions, graphs_kept, quads_updated, quads_reloaded, known_stores, shared_names, now_view_full, resume_after, rewound_commits, emit_values, malformed_sidecars, lines_resolved, keys_noted, doc_facts)

_KIT = f"'<{BASE}kit/"
_OWN = f"{_KIT}Nation/' || (p_partkey % 25) || '>'"
_PROP = f"{_KIT}part/' || p_partkey || '>'"
_SIZE = f"{_KIT}size/' || p_partkey || '>'"
_Q = f"SELECT '<{BASE}user/' || user_id || '>' AS s, '<{BASE}did>' AS p, '\"' || (event_id % 100) || '\"' AS o, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN '<{BASE}graph/history>' WHEN event_type = 'click' THEN '<{BASE}graph/ontology>' ELSE '<{BASE}graph/' || event_type || '>' END AS g FROM events"
_LIVE_PROPS = f"SELECT {_OWN} AS class, {_PROP} AS prop, CASE WHEN p_size % 2 = 0 THEN 'datatype' ELSE 'object' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN {_SIZE} END AS range, CAST(NULL AS VARCHAR) AS comment FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 11 > 0"

_SQL = {
    "mixed_dataset": f"SELECT '{BASE}region/' || r_regionkey AS r, r_name AS n FROM region UNION ALL SELECT '{BASE}region/' || (n_nationkey + 90), 'extra ' || n_name FROM nation",
    "exists_in_or": f"SELECT '{BASE}customer/' || c_custkey AS c, c_acctbal AS b FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > c_acctbal)",
    "path_zero_absent": f"SELECT '{BASE}absent' AS y",
    "path_chain": f"SELECT '{BASE}customer/' || (c_custkey + 1) AS y FROM customer WHERE c_custkey >= 1",
    "sum_error": "SELECT CAST(event_id % 10 AS VARCHAR) AS k, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(sum(event_id % 7) AS DOUBLE) END AS total FROM events GROUP BY event_id % 10",
    "term_functions": f"SELECT n_name AS n, '{XSD}integer' AS dt, '' AS l, sha1(n_name) AS h, false AS b, n_name AS t FROM nation",
    "time_parts": f"SELECT '{BASE}events/' || event_id AS e, hour(ts) AS h, minute(ts) AS m, day(ts) AS d FROM events",
    "grouped_count_ordered": "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC",
    "vocabulary_classes": f"SELECT {_KIT}Nation/' || n_nationkey || '>' AS class FROM nation WHERE n_nationkey % 7 <> 3",
    "vocabulary_properties": _LIVE_PROPS,
    "vocabulary_enums": f"SELECT {_SIZE} AS datatype, pos, split_part(p_name, ' ', 1) || ' ' || (9 - pos) AS value FROM part, (VALUES (0), (1), (2)) v(pos) WHERE p_partkey % 2 = 0",
    "vocabulary_required": f"SELECT DISTINCT {_OWN} AS class, {_PROP} AS prop FROM part WHERE p_size % 4 < 2 AND p_size % 3 >= 1",
    "vocabulary_qualified": f"SELECT {_OWN} AS class, {_PROP} AS prop, {_KIT}Nation/' || (p_size % 25) || '>' AS on_class, p_size AS n, p_size % 3 = 0 AS exact FROM part WHERE p_size % 4 = 2",
    "vocabulary_bounded": f"SELECT {_SIZE} AS datatype, '<{XSD}integer>' AS base, facet, CAST(CASE WHEN facet = 'minInclusive' THEN p_size ELSE p_size + 10 END AS VARCHAR) AS value FROM part, (VALUES ('minInclusive'), ('maxInclusive')) v(facet) WHERE p_partkey % 2 = 1",
    "vocabulary_domain_open": f"SELECT {_PROP} AS prop FROM part WHERE p_partkey % 5 = 0",
    "vocabulary_ranges": f"SELECT prop, range FROM ({_LIVE_PROPS}) WHERE kind = 'object' AND range IS NOT NULL",
    "vocabulary_compact": f"""WITH own AS (SELECT p_partkey, {_OWN} AS class, 'Nation' FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 11 > 0),
      lines AS (SELECT p_partkey % 25 AS k, string_agg(line, chr(10) ORDER BY line) AS lines FROM (SELECT p_partkey, '  ' || p_partkey || ' ' || CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'string' END || ' [' || CASE WHEN p_size % 4 < 2 AND p_size % 3 >= 1 THEN '1' ELSE '0' END || '..*]' AS line FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 11 > 0) GROUP BY 1)
      SELECT {_KIT}Nation/' || n_nationkey || '>' AS class, 'class ' || n_nationkey || CASE WHEN n_regionkey <> n_nationkey THEN ' < ' || n_regionkey ELSE '' END || coalesce(chr(10) || lines, '') AS text FROM nation LEFT JOIN lines ON k = n_nationkey WHERE n_nationkey % 7 <> 3""",
    "shape_from_vocabulary": "SELECT o_orderkey AS key, 'o_orderstatus' AS prop, 'in' AS rule FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'o_totalprice', 'low' FROM orders WHERE o_totalprice < 1000 UNION ALL SELECT o_orderkey, 'o_totalprice', 'high' FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey, 'o_orderpriority', 'datatype' FROM orders WHERE try_cast(o_orderpriority AS BIGINT) IS NULL",
    "hist_eight_commits": """WITH v AS (SELECT DISTINCT ordinal, p_partkey AS s, CASE WHEN ordinal % 4 = 0 THEN p_size + 1 ELSE p_size END AS o FROM part, range(1, 9) r(ordinal) WHERE (ordinal + p_partkey) % 5 > 1)
      SELECT ordinal, s, o, '+' AS op FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.ordinal = a.ordinal - 1 AND b.s = a.s AND b.o = a.o) UNION ALL SELECT ordinal + 1, s, o, '-' FROM v a WHERE ordinal < 8 AND NOT EXISTS (SELECT 1 FROM v b WHERE b.ordinal = a.ordinal + 1 AND b.s = a.s AND b.o = a.o)""",
    "hist_event_quads": f"""WITH e AS (SELECT DISTINCT event_id // 10 AS c, user_id, event_type, CASE WHEN event_type = 'view' THEN '-' ELSE '+' END AS op FROM events)
      SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#reifies' AS p, 'told' AS o, count(*) AS n FROM e WHERE false""",
    "sidecar_lines": "SELECT c_custkey % 4 AS \"commit\", 'doc/' || c_custkey AS path, CASE WHEN c_nationkey < 20 THEN 2 END AS pos, CASE WHEN c_nationkey < 20 THEN 'kit.Nation.name | hasValue | ' || n_name END AS line FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "sidecar_resolved": f"""WITH c AS (SELECT 'doc/' || c_custkey AS path, '<{BASE}Customer/' || c_custkey || '>' AS s, '<{BASE}File/doc/' || c_custkey || '>' AS f, * FROM customer)
      SELECT path, s, '<{BASE}name>' AS p, '"' || c_name || '"' AS o FROM c UNION ALL SELECT path, s, '<{BASE}id>', '"' || c_custkey || '"' FROM c UNION ALL SELECT path, s, '<{BASE}nation>', '<{BASE}Nation/' || c_nationkey || '>' FROM c
      UNION ALL SELECT path, f, '<{BASE}md/linksTo>', '<{BASE}File/other/' || c_custkey || '.md>' FROM c UNION ALL SELECT path, s, '<{BASE}fileId>', f FROM c UNION ALL SELECT path, s, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<{BASE}Customer>' FROM c""",
    "sidecar_dropped": "SELECT count(*) AS lines, count(*) FILTER (p_size % 4 = 1) AS malformed, count(*) FILTER (p_size % 4 = 0) AS empty, count(*) FILTER (p_size % 4 = 2) AS unknown FROM part",
    "sidecar_changes": """WITH n AS (SELECT 'doc/' || c_nationkey AS path, string_agg(DISTINCT c_mktsegment, chr(10) ORDER BY c_mktsegment) || chr(10) AS new FROM customer WHERE c_nationkey < 20 GROUP BY 1),
      o AS (SELECT 'doc/' || n_nationkey AS path, CASE WHEN n_nationkey % 2 = 0 THEN 'AUTOMOBILE' || chr(10) || 'BUILDING' || chr(10) || 'FURNITURE' || chr(10) || 'HOUSEHOLD' || chr(10) || 'MACHINERY' || chr(10) ELSE 'old' || chr(10) END AS old FROM nation WHERE n_nationkey > 5)
      SELECT coalesce(n.path, o.path) AS path, CASE WHEN new IS NULL THEN 'remove' ELSE 'write' END AS action, new AS content FROM n FULL JOIN o ON n.path = o.path WHERE new IS DISTINCT FROM old""",
    "dev_horizon": "WITH f AS (SELECT min(event_id) + 1 AS first FROM events WHERE ts >= (SELECT date_trunc('day', min(ts)) FROM events)) SELECT event_id + 1 AS ordinal, CASE WHEN event_id + 1 > first THEN CAST(event_id - 1 AS VARCHAR) END AS base FROM events, f WHERE event_id + 1 >= first",
    "now_only_facts": f"SELECT '<{BASE}git/path>' AS p, count(*) AS n, count(DISTINCT p_name) AS kinds FROM (SELECT DISTINCT p_name, CASE WHEN p_size > 10 THEN 1 END AS b FROM part) UNION ALL SELECT '<{BASE}git/blobHash>', count(*), count(DISTINCT p_name) FROM (SELECT DISTINCT p_name FROM part WHERE p_size > 10)",
    "kit_hints": "SELECT DISTINCT o_orderstatus || '/' || o_custkey AS value, '<' || o_orderstatus || '/' || o_custkey || '>' AS suggestion FROM orders WHERE o_orderstatus <> 'F'",
    "old_date_keys": "SELECT CASE WHEN event_type = 'view' THEN 'kit.Doc.createdDate' WHEN event_type = 'click' THEN 'kit.Doc.dateUpdated' ELSE 'kit.Doc.title' END AS subject, count(*) AS n FROM events GROUP BY 1",
    "date_stamps": "SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 3 = 0 THEN '2024-05-05' ELSE '2020-01-01' END AS created, CASE WHEN p_partkey % 3 = 1 THEN '2020-01-02' ELSE '2024-05-05' END AS updated FROM part",
    "healed_links": "SELECT CAST(c_custkey AS VARCHAR) AS path, 'See [a](' || CASE WHEN n_name IS NOT NULL THEN '/new%20doc/' || replace(n_name, ' ', '%20') || '.md' ELSE '/doc/' || (c_custkey % 40) || '.md' END || '#top) and [b](other.md).' AS content FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 40",
    "doc_typed": "SELECT p_partkey AS doc, 'kit/size' AS prop, CAST(p_size AS VARCHAR) AS value, CASE WHEN p_partkey % 50 = 0 THEN 'nested' END AS error FROM part UNION ALL SELECT p_partkey, 'kit/brand', p_brand, CASE WHEN p_partkey % 50 = 0 THEN 'nested' WHEN try_cast(p_brand AS BIGINT) IS NULL THEN 'datatype' END FROM part UNION ALL SELECT p_partkey, 'who', p_type, CASE WHEN p_partkey % 50 = 0 THEN 'nested' ELSE 'unknown key' END FROM part",
    "graph_descriptions": f"SELECT g AS graph, CASE WHEN g LIKE '%/history>' THEN 'HistoryGraph' WHEN g LIKE '%/ontology>' THEN 'OntologyGraph' ELSE 'CurrentGraph' END AS class, 'me' AS owner, 'private' AS visibility, count(*) AS quads FROM ({_Q}) WHERE g IS NOT NULL GROUP BY g",
    "graphs_kept": f"SELECT g, count(*) AS n FROM ({_Q}) WHERE g IS NULL OR g LIKE '%/ontology>' GROUP BY g",
    "quads_updated": f"SELECT g, count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT * FROM ({_Q}) WHERE g IS NULL OR g NOT LIKE '%/history>' UNION ALL SELECT s, p, '\"new\"', g FROM ({_Q}) WHERE g IS NULL)) GROUP BY g",
    "quads_reloaded": "SELECT change, event_type, count(*) AS n FROM (SELECT '+' AS change, * FROM (SELECT user_id, event_type FROM events WHERE event_id % 3 < 2 EXCEPT ALL SELECT user_id, event_type FROM events WHERE event_id % 3 > 0) UNION ALL SELECT '-', * FROM (SELECT user_id, event_type FROM events WHERE event_id % 3 > 0 EXCEPT ALL SELECT user_id, event_type FROM events WHERE event_id % 3 < 2)) GROUP BY 1, 2",
    "known_stores": "SELECT '/home/' || c_nationkey AS path, max(c_custkey) AS last_used, arg_max(c_name, c_custkey) AS name FROM customer WHERE c_nationkey % 2 = 0 GROUP BY c_nationkey",
    "shared_names": f"SELECT CASE WHEN g LIKE '%/ontology>' THEN p ELSE '<{BASE}has/done>' END AS p, g, count(*) AS n FROM ({_Q}) GROUP BY 1, 2",
    "now_view_full": f"SELECT s, count(*) AS n FROM ({_Q}) WHERE s NOT IN (SELECT s FROM ({_Q}) WHERE o = '\"7\"') GROUP BY s",
    "resume_after": "SELECT CAST(max(event_id) AS VARCHAR) AS \"commit\", max(event_id) AS ordinal FROM events WHERE event_id % 10 < 7",
    "rewound_commits": "SELECT CAST(event_id AS VARCHAR) AS \"commit\" FROM events WHERE event_id % 10 = 9",
    "lines_resolved": f"""WITH c AS (SELECT 'doc/' || c_custkey AS path, '<{BASE}kit/Customer/' || c_custkey || '>' AS s, '<{BASE}File/doc/' || c_custkey || '>' AS f, * FROM customer),
        k AS (SELECT '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' AS a, '<{BASE}ontology/kit/' AS n),
        r AS (SELECT path, s, n || 'customerId>' AS p, '"' || c_custkey || '"' AS o FROM c, k
        UNION ALL SELECT path, s, '<{BASE}ontology/root/balance>', '"' || c_nationkey || '"^^<{XSD}decimal>' FROM c
        UNION ALL SELECT path, s, n || 'nation>', '<{BASE}kit/Nation/' || unnest([c_nationkey, 7]) || '>' FROM c, k
        UNION ALL SELECT path, s, n || 'seeAlso>', '<{BASE}kit/Nation/1>' FROM c, k
        UNION ALL SELECT path, s, n || 'createdDate>', '"2024-01-02"^^<{XSD}date>' FROM c, k
        UNION ALL SELECT path, s, n || 'remark>', '"a \\"b\\""' FROM c, k
        UNION ALL SELECT path, s, n || 'segment>', '"' || c_mktsegment || '"' FROM c, k
        UNION ALL SELECT path, s, n || 'population>', '"1"' FROM c, k
        UNION ALL SELECT path, s, n || 'names>', '"n"' FROM c, k
        UNION ALL SELECT path, f, '<{BASE}fm/old-links>', unnest(['<{BASE}File/a/b.md>', '"plain"']) FROM c
        UNION ALL SELECT path, f, '<{BASE}md/externalLink>', '"https://x.example/"' FROM c
        UNION ALL SELECT path, f, a, '<{BASE}File>' FROM c, k
        UNION ALL SELECT path, s, a, n || 'Customer>' FROM c, k
        UNION ALL SELECT path, s, '<{BASE}fileId>', f FROM c)
        SELECT DISTINCT path, s, p, o, CAST(NULL AS VARCHAR) AS error FROM r UNION ALL SELECT path, NULL, NULL, NULL, unnest(['wiki link', 'no address of a thing']) FROM c""",
    "doc_facts": """WITH d AS (SELECT 'doc/' || p_partkey || '.md' AS path, CAST(p_partkey AS VARCHAR) AS k, * FROM part)
        SELECT path, 'Title' AS subject, 'hasValue' AS op, p_name AS "object" FROM d UNION ALL SELECT path, 'size', 'hasValue', CAST(p_size AS VARCHAR) FROM d
        UNION ALL SELECT path, 'kit.Part.id', 'hasValue', 'p' || k FROM d UNION ALL SELECT path, 'tags', 'hasValue', unnest(['a', k]) FROM d
        UNION ALL SELECT path, CASE WHEN p_partkey % 3 = 0 THEN 'md.unresolvedLink' ELSE path END, CASE WHEN p_partkey % 3 = 0 THEN 'hasValue' ELSE 'linksTo' END, CASE WHEN p_partkey % 3 = 0 THEN '../no where/' || k ELSE path END FROM d
        UNION ALL SELECT path, 'md.externalLink', 'hasValue', 'https://x.example/' || k FROM d""",
    "keys_noted": "SELECT 'kit' AS kit, 'Customer' AS class, * FROM (VALUES ('segment', 'deprecated', 'name'), ('population', 'elsewhere', 'Nation'), ('names', 'unknown', 'name')) v(prop, note, names)",
    "emit_values": f"SELECT p_partkey, CASE WHEN p_partkey % 6 < 3 THEN 'iri' ELSE 'error' END AS kind, CASE p_partkey % 6 WHEN 0 THEN '{BASE}a/' || p_partkey WHEN 1 THEN '{BASE}File/docs/' || p_partkey || '.md' WHEN 2 THEN 'https://x.example/' || p_partkey END AS value, CASE p_partkey % 6 WHEN 3 THEN 'wiki link' WHEN 4 THEN 'mention' WHEN 5 THEN 'bare name' END AS error FROM part",
    "malformed_sidecars": "SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'fields' WHEN 2 THEN 'operator' WHEN 3 THEN 'subject' ELSE 'empty link' END AS problem FROM part WHERE p_partkey % 5 > 0",
}
# facts about events: as many told as there are events, each with its commit and kind
_SQL["hist_event_quads"] = f"""WITH e AS (SELECT DISTINCT event_id // 10 AS c, user_id, event_type, CASE WHEN event_type = 'view' THEN '-' ELSE '+' END AS op FROM events)
  SELECT '<http://www.w3.org/1999/02/22-rdf-syntax-ns#reifies>' AS p, 'told' AS o, count(*) AS n FROM e
  UNION ALL SELECT CASE op WHEN '+' THEN '<{BASE}assertedIn>' ELSE '<{BASE}retractedIn>' END, '<{BASE}commit/' || c || '>', count(*) FROM e GROUP BY op, c
  UNION ALL SELECT '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', CASE op WHEN '+' THEN '<{BASE}Assertion>' ELSE '<{BASE}Retraction>' END, count(*) FROM e GROUP BY op"""


def queries() -> dict:
    return {f.__name__: f for f in _FUNCTIONS}


def oracle_sql() -> dict[str, str]:
    return _SQL
