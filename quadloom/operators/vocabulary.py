"""What a vocabulary says: classes, properties, lists, restrictions, lookups. Input is a frame of triples (s, p, o) as term text.

Vocabularies are small, but nothing here depends on that: all are joins and grouped passes over the triples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from .shapes import Constraint

_RDF, _RDFS, _OWL = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#{}>", "<http://www.w3.org/2000/01/rdf-schema#{}>", "<http://www.w3.org/2002/07/owl#{}>"
TYPE, FIRST, REST, NIL = (_RDF.format(x) for x in ("type", "first", "rest", "nil"))
_FACETS = {"minInclusive": "low", "maxInclusive": "high", "minExclusive": "above", "maxExclusive": "below", "minLength": "min_length", "maxLength": "max_length", "pattern": "pattern"}
_XSD = "<http://www.w3.org/2001/XMLSchema#{}>"


def _of(triples: DataFrame, predicate: str, name: str) -> DataFrame:
    return triples.where(F.col("p") == predicate).select("s", F.col("o").alias(name))


def deprecated(triples: DataFrame) -> DataFrame:
    """(s): terms marked as deprecated."""
    return triples.where((F.col("p") == _OWL.format("deprecated")) & (T.lex(F.col("o")) == "true")).select("s").distinct()


def list_items(triples: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(head, pos, item) of RDF lists, items in list order, literals and IRIs; a list that comes back to itself ends there."""
    cells = _of(triples, FIRST, "item").join(_of(triples, REST, "rest"), "s", "left").select(F.col("s").alias("cell"), "item", "rest").dropDuplicates(["cell"])
    if heads is None:
        heads = cells.select("cell").join(cells.select(F.col("rest").alias("cell")), "cell", "left_anti")
    now = heads.select(F.col("cell").alias("head"), "cell", F.lit(0).alias("pos"), F.array("cell").alias("seen"))
    out = None
    while True:
        at = now.join(cells, "cell").select("head", "cell", "pos", "item", "rest", "seen").cache()
        if at.isEmpty():
            break
        rows = at.select("head", "pos", "item")
        out = rows if out is None else out.unionByName(rows)
        now = at.where((F.col("rest") != NIL) & ~F.array_contains("seen", F.col("rest"))).select("head", F.col("rest").alias("cell"), (F.col("pos") + 1).alias("pos"), F.array_append("seen", F.col("rest")).alias("seen"))
    return out if out is not None else now.select("head", "pos", F.lit(None).cast("string").alias("item")).where("false")


def classes(triples: DataFrame, namespace: str) -> DataFrame:
    """(class): classes of a namespace that are not deprecated."""
    own = triples.where((F.col("p") == TYPE) & (F.col("o") == _OWL.format("Class")) & F.col("s").startswith(f"<{namespace}")).select("s").distinct()
    return own.join(deprecated(triples), "s", "left_anti").select(F.col("s").alias("class"))


def properties(triples: DataFrame) -> DataFrame:
    """(class, prop, kind, range, comment): properties by domain that are not deprecated; range and comment may be null."""
    kinds = triples.where((F.col("p") == TYPE) & F.col("o").isin(_OWL.format("DatatypeProperty"), _OWL.format("ObjectProperty")))
    kinds = kinds.groupBy("s").agg(F.max(F.when(F.col("o") == _OWL.format("ObjectProperty"), "object").otherwise("datatype")).alias("kind"))
    one = lambda p, n: _of(triples, p, n).groupBy("s").agg(F.min(n).alias(n))
    domain = _of(triples, _RDFS.format("domain"), "class").distinct()
    rows = kinds.join(domain, "s").join(one(_RDFS.format("range"), "range"), "s", "left").join(one(_RDFS.format("comment"), "comment"), "s", "left")
    return rows.join(deprecated(triples), "s", "left_anti").select("class", F.col("s").alias("prop"), "kind", "range", T.lex(F.col("comment")).alias("comment"))


def enums(triples: DataFrame) -> DataFrame:
    """(datatype, pos, value): the literals that a datatype is one of, in order."""
    heads = _of(triples, _OWL.format("oneOf"), "cell").withColumnRenamed("s", "datatype")
    items = list_items(triples, heads.select("cell"))
    return heads.join(items, F.col("cell") == F.col("head")).where(T.is_literal(F.col("item"))).select("datatype", "pos", T.lex(F.col("item")).alias("value"))


def _restrictions(triples: DataFrame) -> DataFrame:
    of_class = triples.where(F.col("p").isin(_RDFS.format("subClassOf"), _OWL.format("equivalentClass"))).select(F.col("s").alias("class"), F.col("o").alias("s"))
    return of_class.join(_of(triples, _OWL.format("onProperty"), "prop"), "s")


def _counts(triples: DataFrame, *names: str) -> DataFrame:
    wanted = triples.where(F.col("p").isin(*(_OWL.format(n) for n in names)))
    return wanted.select("s", F.regexp_extract("p", r"#(\w+)>", 1).alias("rule"), T.number(F.col("o")).cast("int").alias("n"))


def required(triples: DataFrame) -> DataFrame:
    """(class, prop): restrictions of one value or more. The number itself says no more than that a value must be there."""
    found = _restrictions(triples).join(_counts(triples, "minCardinality", "cardinality").where("n >= 1"), "s")
    return found.select("class", "prop").distinct()


def qualified(triples: DataFrame) -> DataFrame:
    """(class, prop, on_class, n, exact): least or exact numbers of values of a class."""
    counts = _counts(triples, "minQualifiedCardinality", "qualifiedCardinality")
    found = _restrictions(triples).join(_of(triples, _OWL.format("onClass"), "on_class"), "s").join(counts, "s")
    return found.select("class", "prop", "on_class", "n", (F.col("rule") == "qualifiedCardinality").alias("exact")).distinct()


def bounded(triples: DataFrame) -> DataFrame:
    """(datatype, base, facet, value): datatypes that narrow another by facets."""
    base = _of(triples, _OWL.format("onDatatype"), "base").withColumnRenamed("s", "datatype")
    heads = _of(triples, _OWL.format("withRestrictions"), "cell").withColumnRenamed("s", "datatype")
    items = list_items(triples, heads.select("cell"))
    facets = triples.where(F.col("p").isin(*(_XSD.format(x) for x in _FACETS))).select(F.col("s").alias("item"), F.regexp_extract("p", r"#(\w+)>", 1).alias("facet"), T.lex(F.col("o")).alias("value"))
    return base.join(heads, "datatype").join(items, F.col("cell") == F.col("head")).join(facets, "item").select("datatype", "base", "facet", "value")


def constraints(triples: DataFrame, cls: str) -> list[Constraint]:
    """The constraints that a class's own properties bring; read back as one table's worth of rules."""
    name = lambda iri: iri.strip("<>").replace("#", "/").rpartition("/")[2]
    own = properties(triples).where(F.col("class") == cls).collect()
    need = {r.prop for r in required(triples).where(F.col("class") == cls).collect()}
    many = {r.prop: r for r in qualified(triples).where(F.col("class") == cls).collect()}
    values: dict = {}
    for r in enums(triples).orderBy("pos").collect():
        values.setdefault(r.datatype, []).append(r.value)
    facets: dict = {}
    for r in bounded(triples).collect():
        facets.setdefault(r.datatype, {"base": r.base})[r.facet] = r.value
    out = []
    for r in sorted(own, key=lambda r: r.prop):
        f = facets.get(r.range, {})
        base = f.get("base", r.range if (r.range or "").startswith("<http://www.w3.org/2001/XMLSchema#") else None)
        number = lambda k, f=f: float(f[k]) if k in f else None
        q = many.get(r.prop)
        out.append(Constraint(name(r.prop), r.prop in need, tuple(values.get(r.range, ())), name(base) if base else None, number("minInclusive"), number("maxInclusive"), f.get("pattern"), q.n if q else 0, q.exact if q else False))
    return out


def domain_open(triples: DataFrame) -> DataFrame:
    """(prop): properties without a domain, which any class may have."""
    kinds = triples.where((F.col("p") == TYPE) & F.col("o").isin(_OWL.format("DatatypeProperty"), _OWL.format("ObjectProperty"))).select("s").distinct()
    return kinds.join(_of(triples, _RDFS.format("domain"), "d"), "s", "left_anti").select(F.col("s").alias("prop"))


def reference_ranges(triples: DataFrame) -> DataFrame:
    """(prop, range): object properties and the class that their values are of."""
    return properties(triples).where("kind = 'object' AND range IS NOT NULL").select("prop", "range").distinct()


def find_class(triples: DataFrame, name: str, kit: str | None = None) -> str:
    """The one class of that name, whatever its case; several in different kits are an error that names them."""
    local = F.lower(F.regexp_extract("s", r"([^/#]*)>$", 1))
    found = triples.where((F.col("p") == TYPE) & (F.col("o") == _OWL.format("Class")) & (local == name.lower()))
    if kit is not None:
        found = found.where(F.lower("s").contains(f"/{kit.lower()}"))
    names = sorted(r.s for r in found.join(deprecated(triples), "s", "left_anti").select("s").distinct().collect())
    if len(names) != 1:
        raise KeyError(f"{name!r}: {'no such class' if not names else 'ambiguous, ' + ', '.join(names)}")
    return names[0]


def compact(triples: DataFrame, namespace: str) -> DataFrame:
    """(class, text): each class with its properties in one compact block, without those that its parent has as well."""
    own = properties(triples).join(required(triples).withColumn("need", F.lit(True)), ["class", "prop"], "left")
    parent = _of(triples, _RDFS.format("subClassOf"), "parent").where(~T.is_blank(F.col("parent"))).withColumnRenamed("s", "class")
    inherited = parent.join(own.select(F.col("class").alias("parent"), "prop"), "parent").select("class", "prop")
    local = lambda c: F.regexp_extract(c, r"([^/#]*)>$", 1)
    line = F.concat(F.lit("  "), local("prop"), F.lit(" "), F.coalesce(local("range"), F.lit("string")), F.lit(" ["), F.when(F.col("need"), "1").otherwise("0"), F.lit("..*]"))
    lines = own.join(inherited, ["class", "prop"], "left_anti").groupBy("class").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    rows = classes(triples, namespace).join(lines, "class", "left").join(parent.groupBy("class").agg(F.min("parent").alias("parent")), "class", "left")
    head = F.concat(F.lit("class "), local("class"), F.coalesce(F.concat(F.lit(" < "), local("parent")), F.lit("")))
    return rows.select("class", F.concat_ws("\n", head, "lines").alias("text"))
