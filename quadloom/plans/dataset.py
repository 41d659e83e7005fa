"""What a query runs over: tables mapped to triples, stored quads, or both.

Inside a plan an IRI of a mapped row is its native key and a literal its native
column, so joins and filters reach the scan as they are. Only where rows of
several kinds meet do they become term text (``<iri>``, ``"lex"^^<dt>``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, TimestampNTZType, TimestampType

from .algebra import RDF_TYPE, XSD

BASE = "https://data.example/"
_KINDS = ((BooleanType, "boolean"), ((ShortType, IntegerType, LongType), "integer"), ((FloatType, DoubleType), "double"), (DecimalType, "decimal"), (DateType, "date"), ((TimestampType, TimestampNTZType), "dateTime"), (StringType, "string"))
NUMERIC = ("integer", "decimal", "double")


@dataclass
class Table:
    """key: the columns that name a row (none: all of them); links: column -> class it refers to."""

    df: DataFrame
    key: tuple[str, ...]
    links: dict[str, str] = field(default_factory=dict)

    def kind(self, column: str) -> str | None:
        if column in self.links:
            return "entity:" + self.links[column]
        return next((k for t, k in _KINDS if isinstance(self.df.schema[column].dataType, t)), None)

    def subject(self) -> Column:
        if len(self.key) == 1:
            return F.col(self.key[0])
        names = self.key or self.df.columns
        return F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in names)))


@dataclass
class Dataset:
    spark: SparkSession
    tables: dict[str, Table] = field(default_factory=dict)
    #: stored quads (s, p, o, g) as term text; g is null in the unnamed graph
    quads: DataFrame | None = None
    #: graph IRI -> class ("CurrentGraph", ...)
    catalog: dict[str, str] = field(default_factory=dict)
    base: str = BASE

    def class_iri(self, name: str) -> str:
        return self.base + name

    def __post_init__(self):
        seen: dict[str, int] = {}
        for t in self.tables.values():
            for c in t.df.columns:
                seen[c] = seen.get(c, 0) + 1
        #: predicate IRI -> (table, column); a name that two tables have is qualified
        self.predicates = {}
        for name, t in self.tables.items():
            for c in t.df.columns:
                if t.kind(c):
                    self.predicates[self.base + (c if seen[c] == 1 else f"{name}_{c}")] = (name, c)

    def text(self, column: Column, kind: str) -> Column:
        """Term text of a native column."""
        if kind == "term":
            return column
        if kind.startswith("entity:"):
            return F.concat(F.lit(f"<{self.base}{kind[7:]}/"), column.cast("string"), F.lit(">"))
        if kind == "string":
            escaped = column
            for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
                escaped = F.replace(escaped, F.lit(a), F.lit(b))
            return F.concat(F.lit('"'), escaped, F.lit('"'))
        lex = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss") if kind == "dateTime" else column.cast("string")
        return F.concat(F.lit('"'), lex, F.lit(f'"^^<{XSD}{kind}>'))

    def may_start(self, kind: str, start: str) -> bool:
        """Whether the STR of a value of that kind can start so."""
        if kind.startswith("entity:"):
            own = f"{self.base}{kind[7:]}/"
            return own.startswith(start) or start.startswith(own)
        return not start or kind not in ("integer", "decimal", "double", "date", "dateTime", "boolean") or start[0] in "+-.0123456789EINeaft"

    def triples(self, without: tuple[str, ...] = (), s_start: str = "", o_start: str = "") -> DataFrame:
        """(s, p, o, g) of all mapped tables, each table a graph of its own. Predicates named in ``without`` are left out,
        and so is what cannot have a subject or an object whose STR starts as given; not all that is left does."""
        parts = []
        for name, t in self.tables.items():
            if not self.may_start("entity:" + name, s_start):
                continue
            here = [(p, c) for p, (n, c) in self.predicates.items() if n == name and p not in without and self.may_start(t.kind(c), o_start)]
            pairs = [F.struct(F.lit(f"<{RDF_TYPE}>").alias("p"), F.lit(f"<{self.class_iri(name)}>").alias("o"))] if RDF_TYPE not in without and self.class_iri(name).startswith(o_start) else []
            pairs += [F.struct(F.lit(f"<{p}>").alias("p"), self.text(F.col(c), t.kind(c)).alias("o")) for p, c in here]
            if not pairs:
                continue
            df = t.df
            if o_start and not any(x.startswith(o_start) for x in (self.class_iri(name),)) and all(t.kind(c) == "string" for _, c in here):
                # only texts are left: rows of which none starts so are dropped before their triples are made
                hit = F.lit(False)
                for _, c in here:
                    hit = hit | F.coalesce(F.col(c).startswith(o_start), F.lit(False))
                df = df.where(hit)
            rows = df.select(self.text(t.subject(), "entity:" + name).alias("s"), F.explode(F.array(*pairs)).alias("x"))
            parts.append(rows.select("s", "x.p", "x.o", F.lit(f"<{self.base}graph/{name}>").alias("g")).where("o is not null"))
        if not parts:
            return self.spark.range(0).select(*(F.lit("").alias(c) for c in "spog"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def scan(self, graph: str | None = None, without: tuple[str, ...] = (), s_start: str = "", o_start: str = "") -> DataFrame:
        """(s, p, o, g): of the default graph (None), of all named graphs ("*") or of one graph; the rest tells what of the
        tables need not be read."""
        parts = []
        if self.tables:
            parts.append(self.triples(without, s_start, o_start))
        if self.quads is not None:
            parts.append(self.quads.select("s", "p", "o", "g"))
        rows = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
        if graph == "*":
            return rows.where("g is not null").distinct() if self.quads is not None else rows
        if graph is not None:
            return rows.where(F.col("g") == f"<{graph}>")
        current = [f"<{g}>" for g, kind in self.catalog.items() if kind == "CurrentGraph"]
        if current:
            rows = rows.where(F.col("g").isNull() | F.col("g").isin(current))
        # a triple in several graphs is one triple of the default graph; tables are disjoint
        return rows.select("s", "p", "o").distinct() if self.quads is not None else rows.select("s", "p", "o")


def star_schema(spark: SparkSession, sf_dir: str) -> Dataset:
    """The benchmark tables as a graph: a class for each table, a predicate for each column, foreign keys as links."""
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}
    links = {"nation": {"n_regionkey": "region"}, "customer": {"c_nationkey": "nation"}, "supplier": {"s_nationkey": "nation"}, "orders": {"o_custkey": "customer"}, "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}}
    names = [*keys, "lineitem"]
    tables = {n: Table(spark.read.parquet(f"{sf_dir}/{n}.parquet"), (keys[n],) if n in keys else (), links.get(n, {})) for n in names}
    return Dataset(spark, tables)
