"""Function calls of query expressions, all as built-in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import XSD
from . import terms as T


def encode_for_uri(c: Column) -> Column:
    """Percent-encodes all but unreserved characters; ``url_encode`` writes a space as a plus sign and keeps the asterisk."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def call(plan, name: str, args: tuple, scope) -> tuple[Column, str]:
    """(column, kind) of a call; ``plan`` compiles its arguments."""
    from ..plans.planner import Unsupported

    if name == "BOUND":
        return scope[args[0][1]][0].isNotNull() if args[0][1] in scope else F.lit(False), "boolean"
    x = [plan.expr(a, scope) for a in args]
    text = [plan.string(c, k) for c, k in x]

    def same_kind(items):
        kinds = {k for _, k in items}
        if len(kinds) == 1:
            return [c for c, _ in items], kinds.pop()
        if kinds <= {"integer", "decimal", "double"}:
            return [c.cast("double") for c, _ in items], "double"
        return [plan.data.text(c, k) for c, k in items], "term"

    if name == "IF":
        (a, b), kind = same_kind(x[1:])
        test = plan.truth(x[0])
        return F.when(test, a).when(~test, b), kind
    if name == "COALESCE":
        cols, kind = same_kind(x)
        return F.coalesce(*cols), kind
    if name == "SAMETERM":
        return plan.data.text(*x[0]) == plan.data.text(*x[1]), "boolean"

    def tested(term_test, native: bool):
        c, kind = x[0]
        if kind == "term":
            return term_test(c), "boolean"
        return F.when(c.isNotNull(), F.lit(native)), "boolean"

    kind = x[0][1] if x else ""
    entity = kind.startswith("entity:")
    if name in ("ISIRI", "ISURI"):
        return tested(T.is_iri, entity)
    if name == "ISLITERAL":
        return tested(T.is_literal, not entity)
    if name == "ISBLANK":
        return tested(T.is_blank, False)
    if name == "ISTRIPLE":
        return tested(T.is_triple, False)
    if name == "ISNUMERIC":
        return tested(lambda c: T.number(c).isNotNull(), kind in ("integer", "decimal", "double"))
    if name == "STR":
        return text[0], "string"
    if name == "LANG":
        return (T.lang(x[0][0]) if kind == "term" else F.when(x[0][0].isNotNull() & F.lit(not entity), F.lit(""))), "string"
    if name == "LANGMATCHES":
        have, want = F.lower(text[0]), F.lower(text[1])
        return F.when(want == "*", have != "").otherwise((have == want) | have.startswith(F.concat(want, F.lit("-")))), "boolean"
    if name == "DATATYPE":
        if kind == "term":
            return F.concat(F.lit("<"), T.datatype(x[0][0]), F.lit(">")), "term"
        return F.when(x[0][0].isNotNull() & F.lit(not entity), F.lit(f"<{XSD}{kind}>")), "term"
    if name in ("IRI", "URI"):
        return F.concat(F.lit("<"), text[0], F.lit(">")), "term"
    if name in ("STRDT", "STRLANG"):
        quoted = plan.data.text(text[0], "string")
        return (F.concat(quoted, F.lit("^^<"), text[1], F.lit(">")) if name == "STRDT" else F.concat(quoted, F.lit("@"), F.lower(text[1]))), "term"
    if name == "UUID":
        return F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")), "term"
    if name == "STRUUID":
        return F.uuid(), "string"
    if name == "BNODE":
        return F.concat(F.lit("_:"), F.md5(text[0]) if text else F.replace(F.uuid(), F.lit("-"), F.lit(""))), "term"
    if name == "TRIPLE":
        s, p, o = (plan.data.text(*y) for y in x)
        return F.concat(F.lit("<<( "), s, F.lit(" "), p, F.lit(" "), o, F.lit(" )>>")), "term"
    if name in ("SUBJECT", "PREDICATE", "OBJECT"):
        k = ("SUBJECT", "PREDICATE", "OBJECT").index(name) + 1
        return F.nullif(F.regexp_extract(x[0][0], r"(?s)^<<\( (\S+) (<[^>]*>) (.*) \)>>$", k), F.lit("")), "term"
    if name in ("HASLANG", "HASLANGDIR"):
        return (T.lang(x[0][0]) != "" if kind == "term" and name == "HASLANG" else F.lit(False)), "boolean"
    if name == "STRLEN":
        return F.length(text[0]).cast("bigint"), "integer"
    if name == "SUBSTR":
        n = x[2][0] if len(x) > 2 else F.lit((1 << 31) - 1)
        return F.substring(text[0], x[1][0].cast("int"), n.cast("int")), "string"
    simple = {"UCASE": F.upper, "LCASE": F.lower, "ENCODE_FOR_URI": encode_for_uri, "MD5": F.md5, "SHA1": F.sha1}
    if name in simple:
        return simple[name](text[0]), "string"
    if name in ("SHA256", "SHA384", "SHA512"):
        return F.sha2(text[0], int(name[3:])), "string"
    if name in ("STRSTARTS", "STRENDS", "CONTAINS"):
        return getattr(text[0], {"STRSTARTS": "startswith", "STRENDS": "endswith", "CONTAINS": "contains"}[name])(text[1]), "boolean"
    if name in ("STRBEFORE", "STRAFTER"):
        at = F.position(text[1], text[0])
        if name == "STRBEFORE":
            return F.when(at > 0, F.substring(text[0], F.lit(1), at - 1)).otherwise(F.lit("")), "string"
        return F.when(at > 0, F.substring(text[0], at + F.length(text[1]), F.lit((1 << 31) - 1))).otherwise(F.lit("")), "string"
    if name == "CONCAT":
        return F.concat(*text) if text else F.lit(""), "string"
    if name == "REGEX":
        flags = F.concat(F.lit("(?"), text[2], F.lit(")")) if len(text) > 2 else F.lit("")
        return F.regexp_like(text[0], F.concat(flags, text[1])), "boolean"
    if name == "REPLACE":
        flags = F.concat(F.lit("(?"), text[3], F.lit(")")) if len(text) > 3 else F.lit("")
        return F.regexp_replace(text[0], F.concat(flags, text[1]), text[2]), "string"
    if name in ("ABS", "ROUND", "CEIL", "FLOOR"):
        c, k = plan.num(x[0])
        if name == "ABS":
            return F.abs(c), k
        rounded = {"ROUND": lambda v: F.floor(v + F.lit(0.5).cast("decimal(2,1)") if k != "double" else v + 0.5), "CEIL": F.ceil, "FLOOR": F.floor}[name](c)
        return rounded.cast({"integer": "bigint", "decimal": "decimal(38,10)", "double": "double"}[k]), k
    if name == "RAND":
        return F.rand(), "double"
    if name == "NOW":
        return F.current_timestamp().cast("timestamp_ntz"), "dateTime"
    parts = {"YEAR": (1, 4), "MONTH": (6, 2), "DAY": (9, 2), "HOURS": (12, 2), "MINUTES": (15, 2)}
    if name in parts:  # from the lexical form, so an offset does not move the clock
        at, n = parts[name]
        return F.substring(text[0], at, n).try_cast("bigint"), "integer"
    if name == "SECONDS":
        return F.regexp_extract(text[0], r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", 1).try_cast("decimal(38,10)"), "decimal"
    if name == "TZ":
        return F.regexp_extract(text[0], r"(Z|[+-]\d\d:\d\d)$", 1), "string"
    if name == "TIMEZONE":
        tz = F.regexp_extract(text[0], r"(Z|[+-]\d\d:\d\d)$", 1)
        hours = F.regexp_replace(F.substring(tz, 2, 2), "^0", "")
        minutes = F.regexp_replace(F.substring(tz, 5, 2), "^0", "")
        lex = F.when(tz == "Z", "PT0S").when(tz != "", F.concat(F.when(tz.startswith("-"), "-PT").otherwise("PT"), hours, F.lit("H"), F.when(minutes != "0", F.concat(minutes, F.lit("M"))).otherwise("")))
        return F.concat(F.lit('"'), lex, F.lit(f'"^^<{XSD}dayTimeDuration>')), "term"
    raise Unsupported(f"unknown function {name}")

