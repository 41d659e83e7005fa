"""Quads as text, and results as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T

_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?|<<\( .* \)>>)'
_LINE = rf"^\s*{_TERM}\s+(<[^>]*>)\s+{_TERM}\s*(<[^>]*>)?\s*\.\s*$"


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, g, line): ``line`` is null, or a line that is no quad (its terms are null then)."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    at = lambda i: F.nullif(F.regexp_extract("value", _LINE, i), F.lit(""))
    return rows.select(at(1).alias("s"), at(2).alias("p"), at(3).alias("o"), at(4).alias("g"), F.when(~F.col("value").rlike(_LINE), F.col("value")).alias("line"))


def write_nquads(quads: DataFrame, path: str) -> None:
    quads.select(F.concat_ws(" ", "s", "p", "o", "g", F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def ntriples(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("line"))


def term_json(term) -> object:
    """A term as the results format has it; a triple term is nested, a plain string has no datatype."""
    t = F.col(term) if isinstance(term, str) else term
    dt, lang = T.datatype(t), T.lang(t)
    kind = F.when(T.is_iri(t), "uri").when(T.is_blank(t), "bnode").when(T.is_triple(t), "triple").otherwise("literal")
    plain = dt.isNull() | dt.endswith("#string") | dt.endswith("#langString")
    return F.struct(kind.alias("type"), F.coalesce(T.lex(t), F.regexp_replace(t, "^_:", "")).alias("value"), F.when(~plain, dt).alias("datatype"), F.when(lang != "", lang).alias("xml:lang"))


def results_json(rows: DataFrame) -> DataFrame:
    """One JSON binding for each row of term text; what is unbound is left out."""
    return rows.select(F.to_json(F.struct(*(F.when(F.col(c).isNotNull(), term_json(c)).alias(c) for c in rows.columns))).alias("binding"))


def results_document(rows: DataFrame, is_ask: bool = False) -> str:
    """The whole results document of a result that fits the driver: head, and results or a boolean."""
    if is_ask:
        return json.dumps({"head": {}, "boolean": bool(rows.first()[0])})
    bindings = ",".join(r.binding for r in results_json(rows).toLocalIterator())
    return '{"head":{"vars":' + json.dumps(rows.columns) + '},"results":{"bindings":[' + bindings + "]}}"


def table_text(rows: DataFrame, limit: int = 1000) -> str:
    """A plain table of at most ``limit`` rows, columns as wide as their widest cell."""
    found = [[("" if v is None else str(v)) for v in r] for r in rows.limit(limit).collect()]
    if not found:
        return "(No results found)"
    width = [max(len(c), *(len(r[i]) for r in found)) for i, c in enumerate(rows.columns)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, width)).rstrip()
    return "\n".join([line(rows.columns), "-+-".join("-" * w for w in width), *map(line, found)])


def shorten(term, prefixes: dict[str, str], base: str = ""):
    """A name by the longest namespace that it lies in, else relative to the base."""
    iri = F.regexp_replace(term, "^<|>$", "")
    out = F.when(F.lit(False), F.lit(""))
    for name, ns in sorted(prefixes.items(), key=lambda x: (-len(x[1]), x[0])):
        local = F.substring(iri, F.lit(len(ns) + 1), F.length(iri))
        out = out.when(T.is_iri(term) & iri.startswith(ns), F.concat(F.lit(name + ":"), local))
    if base:
        out = out.when(T.is_iri(term) & iri.startswith(base), F.concat(F.lit("<"), F.substring(iri, F.lit(len(base) + 1), F.length(iri)), F.lit(">")))
    return out.otherwise(term)


def spine(quads: DataFrame, prefixes: dict[str, str], base: str = "", graphs: list[str] | None = None) -> DataFrame:
    """(s, p, o), shortened, without blank nodes and triple terms, tabs escaped, sorted, each row once; ``graphs`` limits the export."""
    if graphs is not None:
        quads = quads.where(F.col("g").isin([f"<{g}>" for g in graphs]))
    named = quads.where(~T.is_blank(F.col("s")) & ~T.is_blank(F.col("o")) & ~T.is_triple(F.col("o")))
    cells = [F.replace(shorten(F.col(c), prefixes, base), F.lit("\t"), F.lit("\\t")).alias(c) for c in ("s", "p", "o")]
    return named.select(*cells).distinct().orderBy("s", "p", "o")


def write_versioned(df: DataFrame, root: str, version: str) -> None:
    """Writes a version beside the others; its success marker comes last, so a broken one reads as absent."""
    df.write.mode("overwrite").parquet(f"{root}/version={version}")


def latest(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest complete version."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(hadoop)
    if not fs.exists(path):
        return None
    found = [s.getPath().toString() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(found)) if found else None
