"""A query for each operator over the benchmark tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_history
from .functions.extract import split_values
from .operators import history, shapes, verify
from .plans.dataset import BASE, Dataset, star_schema
from .plans.engine import Engine
from .sources.quads import spine

_TEXT: dict[str, tuple[str, str]] = {}


def _graph(name: str, text: str, sql: str) -> None:
    _TEXT[name] = (text, sql)


_graph(
    "bgp_region_totals",
    "SELECT ?region (COUNT(?c) AS ?n) (SUM(?bal) AS ?total) WHERE { ?c a :customer ; :c_nationkey ?x ; :c_acctbal ?bal . ?x :n_regionkey ?r . ?r :r_name ?region } GROUP BY ?region",
    "SELECT r_name AS region, count(*) AS n, sum(c_acctbal) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
_graph("bgp_star", "SELECT ?status ?price ?date WHERE { ?o a :orders ; :o_orderstatus ?status ; :o_totalprice ?price ; :o_orderdate ?date }", "SELECT o_orderstatus AS status, o_totalprice AS price, o_orderdate AS date FROM orders")
_graph(
    "bgp_chain",
    "SELECT ?region (SUM(?q) AS ?quantity) WHERE { ?l :l_orderkey ?o ; :l_quantity ?q . ?o :o_custkey ?c . ?c :c_nationkey ?n . ?n :n_regionkey ?r . ?r :r_name ?region } GROUP BY ?region",
    "SELECT r_name AS region, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
_graph(
    "bgp_repeat_var",
    "SELECT ?nation (COUNT(*) AS ?pairs) WHERE { ?s :s_nationkey ?n . ?c :c_nationkey ?n . ?n :n_name ?nation } GROUP BY ?nation",
    "SELECT n_name AS nation, count(*) AS pairs FROM supplier JOIN customer ON s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name",
)
_graph("filter_cmp", "SELECT ?p ?price WHERE { ?p :p_retailprice ?price FILTER(?price > 920 && ?price <= 950.5) }", f"SELECT '{BASE}part/' || p_partkey AS p, p_retailprice AS price FROM part WHERE p_retailprice > 920 AND p_retailprice <= 950.5")
_graph(
    "filter_in",
    'SELECT ?c ?s WHERE { ?c :c_mktsegment ?s FILTER(?s IN ("BUILDING", "MACHINERY")) }',
    f"SELECT '{BASE}customer/' || c_custkey AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
_graph(
    "filter_regex",
    'SELECT ?name WHERE { ?p :p_name ?name FILTER(REGEX(?name, "[aeiou]{2}") && !CONTAINS(LCASE(?name), "green")) }',
    "SELECT p_name AS name FROM part WHERE regexp_matches(p_name, '[aeiou]{2}') AND NOT contains(lower(p_name), 'green')",
)
_graph(
    "optional_filter",
    "SELECT ?c ?o ?price WHERE { ?c a :customer OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?price FILTER(?price > 300000) } }",
    f"SELECT '{BASE}customer/' || c_custkey AS c, '{BASE}orders/' || o_orderkey AS o, o_totalprice AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000",
)
_graph(
    "optional_chain_unbound",
    'SELECT ?n ?x WHERE { ?n a :nation OPTIONAL { ?s :s_nationkey ?n ; :s_name ?x FILTER(?x < "Supplier#000000005") } OPTIONAL { ?n :n_name ?x } }',
    f"""SELECT '{BASE}nation/' || n_nationkey AS n, coalesce(s_name, n_name) AS x FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_name < 'Supplier#000000005'""",
)
_graph(
    "union_pad",
    "SELECT ?c ?s ?n WHERE { { ?c :c_nationkey ?n FILTER(?n = <https://data.example/nation/3>) } UNION { ?s :s_nationkey ?n } }",
    f"SELECT '{BASE}customer/' || c_custkey AS c, NULL AS s, '{BASE}nation/' || c_nationkey AS n FROM customer WHERE c_nationkey = 3 UNION ALL SELECT NULL, '{BASE}supplier/' || s_suppkey, '{BASE}nation/' || s_nationkey FROM supplier",
)
_graph("minus", "SELECT ?c WHERE { ?c a :customer MINUS { ?o :o_custkey ?c ; :o_totalprice ?p FILTER(?p > 400000) } }", f"SELECT '{BASE}customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
_graph("minus_disjoint", "SELECT ?c WHERE { ?c a :customer MINUS { ?o :o_custkey ?d } }", f"SELECT '{BASE}customer/' || c_custkey AS c FROM customer")
_graph("not_exists", "SELECT ?p WHERE { ?p a :part FILTER NOT EXISTS { ?l :l_partkey ?p ; :l_quantity ?q FILTER(?q >= 49) } }", f"SELECT '{BASE}part/' || p_partkey AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
_graph(
    "exists",
    'SELECT ?c WHERE { ?c a :customer FILTER EXISTS { ?o :o_custkey ?c ; :o_orderpriority "1-URGENT" } }',
    f"SELECT '{BASE}customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
)
_graph(
    "not_exists_theta",
    "SELECT ?e ?u WHERE { ?e :user_id ?u ; :ts ?t FILTER NOT EXISTS { ?f :user_id ?u ; :ts ?later FILTER(?later > ?t) } }",
    f"SELECT '{BASE}events/' || event_id AS e, user_id AS u FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.ts > e.ts)",
)
_graph(
    "values_undef",
    'SELECT ?c ?s ?b WHERE { ?c :c_mktsegment ?s ; :c_acctbal ?b VALUES (?s ?c) { ("BUILDING" :c) (UNDEF <https://data.example/customer/7>) ("MACHINERY" UNDEF) } }',
    f"SELECT '{BASE}customer/' || c_custkey AS c, c_mktsegment AS s, c_acctbal AS b FROM customer, (VALUES ('BUILDING', -1), (NULL, 7), ('MACHINERY', NULL)) v(s, k) WHERE (v.s IS NULL OR v.s = c_mktsegment) AND (v.k IS NULL OR v.k = c_custkey)",
)
_graph(
    "bind_expr",
    "SELECT ?l ?net WHERE { ?x :l_linenumber ?l ; :l_extendedprice ?p ; :l_discount ?d BIND(?p * (1.0e0 - ?d) AS ?net) }",
    "SELECT CAST(l_linenumber AS INTEGER) AS l, l_extendedprice * (1.0 - l_discount) AS net FROM lineitem",
)
_graph(
    "coalesce_if",
    'SELECT ?c (IF(?b < 0, "owes", "even") AS ?state) (COALESCE(?none, ?seg) AS ?s) WHERE { ?c :c_acctbal ?b ; :c_mktsegment ?seg }',
    f"SELECT '{BASE}customer/' || c_custkey AS c, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'even' END AS state, c_mktsegment AS s FROM customer",
)
_graph(
    "graph_var",
    "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } FILTER(CONTAINS(STR(?g), \"graph/nation\") || CONTAINS(STR(?g), \"graph/region\")) } GROUP BY ?g",
    f"SELECT '{BASE}graph/nation' AS g, 4 * count(*) AS n FROM nation UNION ALL SELECT '{BASE}graph/region', 3 * count(*) FROM region",
)
_graph("graph_const", "SELECT ?s ?name WHERE { GRAPH <https://data.example/graph/region> { ?s :r_name ?name } }", f"SELECT '{BASE}region/' || r_regionkey AS s, r_name AS name FROM region")
_graph("distinct", "SELECT DISTINCT ?b ?t WHERE { ?p :p_brand ?b ; :p_type ?t }", "SELECT DISTINCT p_brand AS b, p_type AS t FROM part")
_graph(
    "top_k",
    "SELECT ?o ?price WHERE { ?o :o_totalprice ?price ; :o_orderkey ?k } ORDER BY DESC(?price) ?k LIMIT 25",
    f"SELECT '{BASE}orders/' || o_orderkey AS o, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
_graph("offset", "SELECT ?k WHERE { ?o :o_orderkey ?k } ORDER BY ?k LIMIT 10 OFFSET 30", "SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30")
_graph(
    "group_having",
    "SELECT ?seg (COUNT(*) AS ?n) (AVG(?b) AS ?mean) WHERE { ?c :c_mktsegment ?seg ; :c_acctbal ?b } GROUP BY ?seg HAVING(COUNT(*) > 20)",
    "SELECT c_mktsegment AS seg, count(*) AS n, avg(c_acctbal) AS mean FROM customer GROUP BY c_mktsegment HAVING count(*) > 20",
)
_graph("count_distinct", "SELECT ?s (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o :o_orderstatus ?s ; :o_custkey ?c } GROUP BY ?s", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
_graph(
    "group_concat",
    'SELECT ?region (GROUP_CONCAT(?name; SEPARATOR="|") AS ?names) WHERE { ?n :n_name ?name ; :n_regionkey ?r . ?r :r_name ?region } GROUP BY ?region',
    "SELECT r_name AS region, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
_graph(
    "min_max_avg",
    "SELECT ?b (MIN(?p) AS ?lo) (MAX(?p) AS ?hi) (SAMPLE(?p) AS ?any) (SUM(DISTINCT ?z) AS ?sizes) WHERE { ?x :p_brand ?b ; :p_retailprice ?p ; :p_size ?z } GROUP BY ?b",
    "SELECT p_brand AS b, min(p_retailprice) AS lo, max(p_retailprice) AS hi, min(p_retailprice) AS any, CAST(sum(DISTINCT p_size) AS BIGINT) AS sizes FROM part GROUP BY p_brand",
)
_graph("empty_group", "SELECT (COUNT(*) AS ?n) (SUM(?b) AS ?total) WHERE { ?c :c_acctbal ?b FILTER(?b > 1.0e12) }", "SELECT 0 AS n, 0.0 AS total")
_graph(
    "subselect",
    "SELECT ?o ?c ?top WHERE { ?o :o_custkey ?c ; :o_totalprice ?top { SELECT ?c (MAX(?p) AS ?top) WHERE { ?x :o_custkey ?c ; :o_totalprice ?p } GROUP BY ?c } }",
    f"SELECT '{BASE}orders/' || o_orderkey AS o, '{BASE}customer/' || o_custkey AS c, o_totalprice AS top FROM orders JOIN (SELECT o_custkey AS k, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) ON o_custkey = k AND o_totalprice = m",
)
_graph(
    "path_seq",
    "SELECT ?c ?region WHERE { ?c :c_nationkey/:n_regionkey/:r_name ?region }",
    f"SELECT '{BASE}customer/' || c_custkey AS c, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
_graph(
    "path_alt",
    "SELECT ?x ?n WHERE { ?x (:c_nationkey|:s_nationkey) ?n . ?n :n_name \"NATION_3\" }",
    f"SELECT '{BASE}customer/' || c_custkey AS x, '{BASE}nation/' || n_nationkey AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' UNION ALL SELECT '{BASE}supplier/' || s_suppkey, '{BASE}nation/' || n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3'",
)
_graph(
    "path_inv",
    "SELECT ?r ?n WHERE { ?r ^:n_regionkey ?n }",
    f"SELECT '{BASE}region/' || n_regionkey AS r, '{BASE}nation/' || n_nationkey AS n FROM nation",
)
_LINKS = f"""SELECT '{BASE}nation/' || n_nationkey AS a, '{BASE}region/' || n_regionkey AS b FROM nation UNION SELECT '{BASE}customer/' || c_custkey, '{BASE}nation/' || c_nationkey FROM customer"""
_graph(
    "path_plus",
    "SELECT ?x ?y WHERE { ?x (:n_regionkey|:c_nationkey)+ ?y }",
    f"WITH RECURSIVE e AS ({_LINKS}), t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a AS x, b AS y FROM t",
)
_graph(
    "path_neg",
    "SELECT ?s (COUNT(*) AS ?n) WHERE { ?s !(:n_name|:n_nationkey|^:c_nationkey) ?o FILTER(STRSTARTS(STR(?s), \"https://data.example/nation/\") && !STRSTARTS(STR(?o), \"https://data.example/nation\")) } GROUP BY ?s",
    # what is left of a nation forward is its region (and its class, which the filter takes out); backward nothing points from a nation but customers' and suppliers' links
    f"""SELECT '{BASE}nation/' || n_nationkey AS s, 1 + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation""",
)
_graph(
    "construct",
    "CONSTRUCT { ?r :holds ?n . ?n :label ?name } WHERE { ?n :n_regionkey ?r ; :n_name ?name }",
    f"""SELECT '<{BASE}region/' || n_regionkey || '>' AS s, '<{BASE}holds>' AS p, '<{BASE}nation/' || n_nationkey || '>' AS o FROM nation UNION ALL SELECT '<{BASE}nation/' || n_nationkey || '>', '<{BASE}label>', '"' || n_name || '"' FROM nation""",
)
_graph("ask", 'ASK { ?n :n_name "NATION_3" }', "SELECT count(*) > 0 AS answer FROM nation WHERE n_name = 'NATION_3'")
_graph(
    "describe",
    'DESCRIBE ?r WHERE { ?r :r_name "ASIA" }',
    f"""SELECT '<{BASE}region/' || r_regionkey || '>' AS s, unnest(['<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<{BASE}r_regionkey>', '<{BASE}r_name>']) AS p,
    unnest(['<{BASE}region>', '"' || r_regionkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>', '"' || r_name || '"']) AS o FROM region WHERE r_name = 'ASIA'""",
)
_graph(
    "string_functions",
    'SELECT ?k (STRLEN(?n) AS ?len) (UCASE(?n) AS ?up) (SUBSTR(?n, 2, 3) AS ?sub) (STRBEFORE(?n, "#") AS ?head) (STRAFTER(?n, "#") AS ?tail) (CONCAT(?n, "!") AS ?cat) (REPLACE(?n, "0+", "z") AS ?rep) (ENCODE_FOR_URI(?n) AS ?enc) (SHA256(?n) AS ?sha) WHERE { ?s :s_name ?n ; :s_suppkey ?k }',
    "SELECT s_suppkey AS k, length(s_name) AS len, upper(s_name) AS up, substr(s_name, 2, 3) AS sub, split_part(s_name, '#', 1) AS head, split_part(s_name, '#', 2) AS tail, s_name || '!' AS cat, regexp_replace(s_name, '0+', 'z', 'g') AS rep, replace(s_name, '#', '%23') AS enc, sha256(s_name) AS sha FROM supplier",
)
_graph(
    "numeric_functions",
    "SELECT ?k (ABS(?b) AS ?a) (ROUND(?b) AS ?r) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) WHERE { ?s :c_acctbal ?b ; :c_custkey ?k }",
    "SELECT c_custkey AS k, abs(c_acctbal) AS a, floor(c_acctbal + 0.5) AS r, ceil(c_acctbal) AS c, floor(c_acctbal) AS f FROM customer",
)
_graph(
    "date_functions",
    "SELECT ?y ?m (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y) (MONTH(?d) AS ?m)",
    "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL",
)
_graph(
    "date_range",
    'SELECT ?o WHERE { ?o :o_orderdate ?d FILTER(?d >= "1995-03-01T00:00:00"^^xsd:dateTime && ?d < "1995-06-01T00:00:00"^^xsd:dateTime) }',
    f"SELECT '{BASE}orders/' || o_orderkey AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-06-01'",
)
_graph(
    "casts",
    'SELECT ?k (xsd:integer(?t) AS ?i) (xsd:string(?p) AS ?s) WHERE { ?x :p_partkey ?p ; :p_retailprice ?price BIND(STRAFTER(CONCAT("n:", STR(?p)), ":") AS ?t) BIND(?p AS ?k) }',
    "SELECT p_partkey AS k, p_partkey AS i, CAST(p_partkey AS VARCHAR) AS s FROM part",
)
_graph(
    "term_tests",
    "SELECT ?p (COUNT(*) AS ?n) (COUNT(?num) AS ?numbers) WHERE { GRAPH <https://data.example/graph/customer> { ?s ?p ?o } BIND(IF(isNumeric(?o), 1, ?none) AS ?num) FILTER(isLiteral(?o) && isIRI(?s)) } GROUP BY ?p",
    f"SELECT '{BASE}' || p AS p, c AS n, CASE WHEN num THEN c ELSE 0 END AS numbers FROM (SELECT count(*) AS c FROM customer), (VALUES ('c_custkey', true), ('c_name', false), ('c_acctbal', true), ('c_mktsegment', false)) v(p, num)",
)


def _run(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(star_schema(spark, sf_dir)).query(_TEXT[name][0])

    return query


def param_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT ?c ?b ?seg WHERE { ?c :c_mktsegment ?seg ; :c_acctbal ?b FILTER(?b >= ?least) }"
    return Engine(star_schema(spark, sf_dir)).query(text, ["seg", "least:decimal=0.0"], seg="BUILDING", least="1000.5")


def _cyclic(spark: SparkSession, sf_dir: str) -> Dataset:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    iri = lambda c: F.concat(F.lit(f"<{BASE}nation/"), c.cast("string"), F.lit(">"))
    n = F.col("n_nationkey")
    quads = nation.select(iri(n).alias("s"), F.lit(f"<{BASE}next>").alias("p"), iri((n * 7 + 3) % 25).alias("o"), F.lit(f"<{BASE}graph/next>").alias("g"))
    return Dataset(spark, {}, quads)


def path_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(_cyclic(spark, sf_dir)).query("SELECT ?x ?y WHERE { ?x :next+ ?y }")


def path_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(_cyclic(spark, sf_dir)).query("SELECT ?y WHERE { <https://data.example/nation/1> :next* ?y }")


def path_opt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(_cyclic(spark, sf_dir)).query("SELECT ?x ?y WHERE { ?x :next? ?y }")


_EDGES = "e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)"


def default_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triple that two graphs hold is one triple; a described current graph hides the others."""
    d = _cyclic(spark, sf_dir)
    d.quads = d.quads.unionByName(d.quads.withColumn("g", F.lit(f"<{BASE}graph/copy>"))).unionByName(d.quads.withColumn("p", F.lit(f"<{BASE}old>")).withColumn("g", F.lit(f"<{BASE}graph/old>")))
    d.catalog = {f"{BASE}graph/next": "CurrentGraph", f"{BASE}graph/copy": "CurrentGraph", f"{BASE}graph/old": "HistoryGraph"}
    return Engine(d).query("SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p")


def triple_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.col("n_nationkey").cast("string")
    stmt = F.concat(F.lit(f"<<( <{BASE}nation/"), key, F.lit(f"> <{BASE}label> \""), F.col("n_name"), F.lit('" )>>'))
    quads = nation.select(F.concat(F.lit(f"<{BASE}event/"), key, F.lit(">")).alias("s"), F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#reifies>").alias("p"), stmt.alias("o"), F.lit(None).cast("string").alias("g"))
    return Engine(Dataset(spark, {}, quads)).query("SELECT ?e ?n ?name WHERE { ?e rdf:reifies <<( ?n :label ?name )>> }")


# history: a statement for each user; some events assert it, the others retract it
def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("stmt"), F.floor(F.col("event_id") / 10).cast("bigint").alias("ordinal"), F.when(F.col("event_type").isin("signup", "purchase", "click"), "+").otherwise("-").alias("op"))


_SQL_LOG = "log AS (SELECT user_id AS stmt, event_id // 10 AS ordinal, CASE WHEN event_type IN ('signup', 'purchase', 'click') THEN '+' ELSE '-' END AS op FROM events)"
_SQL_MARKS = f"{_SQL_LOG}, marks AS (SELECT stmt, max(ordinal) FILTER (op = '+') AS a, max(ordinal) FILTER (op = '-') AS r FROM log GROUP BY stmt)"


def hist_live(spark, sf_dir):
    return history.live(_log(spark, sf_dir), ["stmt"])


def hist_asof(spark, sf_dir):
    return history.live(_log(spark, sf_dir), ["stmt"], at=500)


def hist_last_op(spark, sf_dir):
    return history.base_layer(_log(spark, sf_dir), ["stmt"])


def hist_lifespan(spark, sf_dir):
    return history.lifespans(_log(spark, sf_dir), ["stmt"])


def hist_changelog(spark, sf_dir):
    commits = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.floor(F.col("event_id") / 10).cast("bigint").alias("ordinal")).agg(F.min("ts").alias("moment"))
    return history.change_log(_log(spark, sf_dir), commits)


def hist_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.floor("value").alias("event_type"), "event_id")
    half = e.agg((F.max("event_id") + 1) / 2).first()[0]
    old, new = (e.where(c).select("user_id", "event_type") for c in (F.col("event_id") < half, F.col("event_id") >= half))
    return history.diff_events(old, new, ["user_id", "event_type"])


def hist_event_ids(spark, sf_dir):
    e = _log(spark, sf_dir).distinct()
    return e.select("stmt", "ordinal", "op", history.event_id(F.col("op"), F.col("ordinal").cast("string"), F.col("stmt").cast("string"), F.lit("p"), F.lit("o")).alias("event_id"))


def hist_guard(spark, sf_dir):
    e = _log(spark, sf_dir).where("ordinal >= 500").select("stmt", "op").distinct()
    held = _log(spark, sf_dir).where("ordinal < 100 AND op = '+'").select("stmt")
    return history.guard_retracts(e, held, ["stmt"])


def now_refresh(spark, sf_dir):
    """Only users with events since ordinal 500 are computed anew; the result is the full one."""
    log = _log(spark, sf_dir)
    changed = log.where("ordinal >= 500")
    before, after = history.live(log, ["stmt"], at=499), history.live(log.join(changed.select("stmt").distinct(), "stmt", "left_semi"), ["stmt"])
    return history.refresh(before, after, changed, "stmt")


def verify_integrity(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select((F.col("event_id") % 4000).alias("event"), F.col("user_id").alias("stmt"), F.when(F.col("event_type") == "view", F.col("event_id")).alias("asserted_in"), F.when(F.col("event_type") != "view", F.col("event_id")).alias("retracted_in"))
    return verify.integrity(rows)


def verify_dangling(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return verify.dangling(orders.select(F.col("o_custkey").alias("commit")), orders.select((F.col("o_custkey") * 2).alias("commit")))


def verify_parity(spark, sf_dir):
    log = _log(spark, sf_dir)
    return verify.parity(history.live(log, ["stmt"], at=900), log, ["stmt"])


def gate_unique(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return verify.duplicate_ids(line.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("thing"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("file")), "thing", "file")


def gate_ref(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    broken = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, -F.col("o_orderkey") - 1).otherwise(F.col("o_custkey")).alias("o_custkey"))
    return verify.unresolved(broken, spark.read.parquet(f"{sf_dir}/customer.parquet"), "o_custkey", "c_custkey")


def shape_validate(spark, sf_dir):
    rules = [shapes.Constraint("o_orderstatus", required=True, values=("F", "O")), shapes.Constraint("o_totalprice", datatype="double", low=1000, high=400000), shapes.Constraint("o_orderpriority", matches="^[1-3]-"), shapes.Constraint("o_orderpriority", datatype="integer")]
    return shapes.validate_table(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", rules)


def shape_qualified(spark, sf_dir):
    """Nations need three suppliers and some customer in the building trade."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    facts = read("supplier").select(F.col("s_nationkey").alias("key"), F.lit("supplier").alias("prop"), F.col("s_name").alias("value")).unionByName(read("customer").select(F.col("c_nationkey").alias("key"), F.lit("customer").alias("prop"), F.col("c_mktsegment").alias("value")))
    rules = [shapes.Constraint("supplier", min_count=3), shapes.Constraint("customer", min_count=8, matches="BUILDING")]
    return shapes.validate_facts(read("nation").select(F.col("n_nationkey").alias("key")), facts, rules)


def extract_links(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")
    return pages.select("page_id", href).select("page_id", "href", F.when(F.col("href").rlike("^https?://"), "external").otherwise("internal").alias("kind"))


def extract_split(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", F.explode(split_values(F.concat_ws(", ", F.split("p_name", " ")))).alias("value"))


def flatten_json(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


def doc_line_dedup(spark, sf_dir):
    """Distinct lines of each document, in order of text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("trim(line) <> ''")


def spine_export(spark, sf_dir):
    graphs = [f"{BASE}graph/{k}" for k in ("region", "nation", "supplier")]
    return spine(star_schema(spark, sf_dir).triples(), {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "d": BASE}, graphs=graphs)


def _functions():
    return (param_bind, path_cycle, path_star, path_opt, default_graph, triple_terms, hist_live, hist_asof, hist_last_op, hist_lifespan, hist_changelog, hist_events, hist_event_ids, hist_guard, now_refresh, verify_integrity, verify_dangling, verify_parity, gate_unique, gate_ref, shape_validate, shape_qualified, extract_links, extract_split, flatten_json, doc_line_dedup, spine_export)


_SQL = {
    "param_bind": f"SELECT '{BASE}customer/' || c_custkey AS c, c_acctbal AS b, c_mktsegment AS seg FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000.5",
    "path_cycle": f"WITH RECURSIVE {_EDGES} SELECT '{BASE}nation/' || a AS x, '{BASE}nation/' || b AS y FROM t",
    "path_star": f"WITH RECURSIVE {_EDGES} SELECT '{BASE}nation/' || b AS y FROM t WHERE a = 1 UNION SELECT '{BASE}nation/1'",
    "path_opt": f"SELECT '{BASE}nation/' || n_nationkey AS x, '{BASE}nation/' || (n_nationkey * 7 + 3) % 25 AS y FROM nation UNION SELECT '{BASE}nation/' || n_nationkey, '{BASE}nation/' || n_nationkey FROM nation",
    "default_graph": f"SELECT '{BASE}next' AS p, count(*) AS n FROM nation",
    "triple_terms": f"SELECT '{BASE}event/' || n_nationkey AS e, '{BASE}nation/' || n_nationkey AS n, n_name AS name FROM nation",
    "hist_live": f"WITH {_SQL_MARKS} SELECT stmt FROM marks WHERE a IS NOT NULL AND (r IS NULL OR r < a)",
    "hist_asof": f"WITH {_SQL_LOG}, marks AS (SELECT stmt, max(ordinal) FILTER (op = '+') AS a, max(ordinal) FILTER (op = '-') AS r FROM log WHERE ordinal <= 500 GROUP BY stmt) SELECT stmt FROM marks WHERE a IS NOT NULL AND (r IS NULL OR r < a)",
    "hist_last_op": f"WITH {_SQL_MARKS} SELECT stmt FROM marks WHERE a IS NOT NULL AND (r IS NULL OR r <= a)",
    "hist_lifespan": f"WITH {_SQL_LOG} SELECT a.stmt, a.ordinal AS born, (SELECT min(ordinal) FROM log r WHERE r.stmt = a.stmt AND r.op = '-' AND r.ordinal >= a.ordinal) AS died FROM (SELECT DISTINCT stmt, ordinal FROM log WHERE op = '+') a",
    "hist_changelog": f"WITH {_SQL_LOG}, c AS (SELECT event_id // 10 AS ordinal, min(ts) AS moment FROM events GROUP BY 1) SELECT log.ordinal, stmt, op, moment FROM log JOIN c ON log.ordinal = c.ordinal",
    "hist_events": "WITH h AS (SELECT (max(event_id) + 1) / 2 AS x FROM events), o AS (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) AS event_type FROM events, h WHERE event_id < x), n AS (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) AS event_type FROM events, h WHERE event_id >= x) SELECT *, '+' AS op FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, '-' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)",
    "hist_event_ids": f"WITH {_SQL_LOG} SELECT DISTINCT stmt, ordinal, op, substr(sha256(op || '|' || ordinal || '|' || stmt || '|p|o'), 1, 16) AS event_id FROM log",
    "hist_guard": f"WITH {_SQL_LOG} SELECT DISTINCT stmt, op FROM log WHERE ordinal >= 500 AND (op = '+' OR stmt NOT IN (SELECT stmt FROM log WHERE ordinal < 100 AND op = '+'))",
    "now_refresh": f"WITH {_SQL_MARKS} SELECT stmt FROM marks WHERE a IS NOT NULL AND (r IS NULL OR r < a)",
    "verify_integrity": "SELECT event, stmts, asserts, retracts FROM (SELECT event_id % 4000 AS event, count(DISTINCT user_id) AS stmts, count(DISTINCT CASE WHEN event_type = 'view' THEN event_id END) AS asserts, count(DISTINCT CASE WHEN event_type <> 'view' THEN event_id END) AS retracts FROM events GROUP BY 1) WHERE stmts > 1 OR asserts > 1 OR retracts > 1 OR (asserts > 0 AND retracts > 0)",
    "verify_dangling": "SELECT DISTINCT o_custkey AS commit FROM orders WHERE o_custkey NOT IN (SELECT o_custkey * 2 FROM orders)",
    "verify_parity": f"WITH {_SQL_MARKS}, d AS (SELECT stmt FROM marks WHERE a IS NOT NULL AND (r IS NULL OR r < a)), m AS (SELECT stmt, max(ordinal) FILTER (op = '+') AS a, max(ordinal) FILTER (op = '-') AS r FROM log WHERE ordinal <= 900 GROUP BY stmt), s AS (SELECT stmt FROM m WHERE a IS NOT NULL AND (r IS NULL OR r < a)) SELECT stmt, 'stored' AS only_in FROM s WHERE stmt NOT IN (SELECT stmt FROM d) UNION ALL SELECT stmt, 'log' FROM d WHERE stmt NOT IN (SELECT stmt FROM s)",
    "gate_unique": "SELECT l_orderkey || '-' || l_linenumber AS thing, count(DISTINCT l_partkey || '-' || l_suppkey) AS files FROM lineitem GROUP BY 1 HAVING files > 1",
    "gate_ref": "SELECT * FROM (SELECT CASE WHEN o_orderkey % 97 = 0 THEN -o_orderkey - 1 ELSE o_custkey END AS o_custkey, o_orderkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "shape_validate": "SELECT o_orderkey AS key, 'o_orderstatus' AS prop, 'in' AS rule FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'o_totalprice', 'low' FROM orders WHERE o_totalprice < 1000 UNION ALL SELECT o_orderkey, 'o_totalprice', 'high' FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey, 'o_orderpriority', 'pattern' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-') UNION ALL SELECT o_orderkey, 'o_orderpriority', 'datatype' FROM orders WHERE try_cast(o_orderpriority AS BIGINT) IS NULL",
    "shape_qualified": "SELECT n_nationkey AS key, 'supplier' AS prop, 'count' AS rule FROM nation WHERE (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) < 3 UNION ALL SELECT n_nationkey, 'customer', 'count' FROM nation WHERE (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING') < 8",
    "extract_links": "SELECT page_id, href, CASE WHEN regexp_matches(href, '^https?://') THEN 'external' ELSE 'internal' END AS kind FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)",
    "extract_split": "SELECT p_partkey, value FROM (SELECT p_partkey, trim(unnest(string_split(array_to_string(string_split(p_name, ' '), ', '), ','))) AS value FROM part) WHERE value <> ''",
    "flatten_json": "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || json_keys(props)[1]) AS value FROM events",
    "doc_line_dedup": "SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''",
    "spine_export": """SELECT DISTINCT * FROM (SELECT 'd:region/' || r_regionkey AS s, 'rdf:type' AS p, 'd:region' AS o FROM region UNION ALL SELECT 'd:region/' || r_regionkey, 'd:r_name', '"' || r_name || '"' FROM region UNION ALL SELECT 'd:region/' || r_regionkey, 'd:r_regionkey', '"' || r_regionkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>' FROM region
    UNION ALL SELECT 'd:nation/' || n_nationkey, 'rdf:type', 'd:nation' FROM nation UNION ALL SELECT 'd:nation/' || n_nationkey, 'd:n_name', '"' || n_name || '"' FROM nation UNION ALL SELECT 'd:nation/' || n_nationkey, 'd:n_nationkey', '"' || n_nationkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>' FROM nation UNION ALL SELECT 'd:nation/' || n_nationkey, 'd:n_regionkey', 'd:region/' || n_regionkey FROM nation
    UNION ALL SELECT 'd:supplier/' || s_suppkey, 'rdf:type', 'd:supplier' FROM supplier UNION ALL SELECT 'd:supplier/' || s_suppkey, 'd:s_name', '"' || s_name || '"' FROM supplier UNION ALL SELECT 'd:supplier/' || s_suppkey, 'd:s_suppkey', '"' || s_suppkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>' FROM supplier
    UNION ALL SELECT 'd:supplier/' || s_suppkey, 'd:s_nationkey', 'd:nation/' || s_nationkey FROM supplier UNION ALL SELECT 'd:supplier/' || s_suppkey, 'd:s_acctbal', '"' || s_acctbal || '"^^<http://www.w3.org/2001/XMLSchema#double>' FROM supplier)""",
}


def queries() -> dict:
    return {name: _run(name) for name in _TEXT} | {f.__name__: f for f in _functions()} | queries_history.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _TEXT.items()} | _SQL | queries_history.oracle_sql()
