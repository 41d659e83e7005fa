"""Reading term text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import XSD

_LITERAL = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'
_LANG = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"


def is_iri(t: Column) -> Column:
    return t.startswith("<") & ~t.startswith("<<")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_triple(t: Column) -> Column:
    return t.startswith("<<(")


def lex(t: Column) -> Column:
    """STR: an IRI's text or a literal's lexical form."""
    raw = F.regexp_extract(t, _LITERAL, 1)
    # a doubled backslash must not join with what follows, so it waits under a name of its own
    plain = F.replace(raw, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\x00", "\\")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.when(is_literal(t), F.when(raw.contains("\\"), plain).otherwise(raw)).when(is_iri(t), F.regexp_replace(t, "^<|>$", ""))


def datatype(t: Column) -> Column:
    dt = F.regexp_extract(t, _LITERAL, 3)
    return F.when(is_literal(t), F.when(F.regexp_extract(t, _LITERAL, 2) != "", _LANG).when(dt == "", XSD + "string").otherwise(dt))


def lang(t: Column) -> Column:
    return F.when(is_literal(t), F.regexp_extract(t, _LITERAL, 2))


def number(t: Column) -> Column:
    """A numeric literal's value, else null."""
    kinds = [XSD + k for k in ("integer", "decimal", "double", "float", "int", "long", "nonNegativeInteger")]
    return F.when(datatype(t).isin(kinds), lex(t).try_cast("double"))


def literal_text(lexical: str, dt: str = XSD + "string", language: str = "") -> str:
    body = lexical.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
    return f'"{body}"' + (f"@{language}" if language else "" if dt == XSD + "string" else f"^^<{dt}>")
