"""Turtle vocabularies. They are of driver size (thousands of triples), so a small parser reads them into one frame."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_XSD = "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<blank>_:[\w.-]*\w)
    |(?P<name>(?:[A-Za-z][\w.-]*)?:(?:[\w:%-]|\.(?=[\w:%-])|\\.)*)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>\^\^|[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


class TurtleError(ValueError):
    pass


def _unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def literal(text: str, suffix: str = "") -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = text.replace(a, b)
    return f'"{text}"{suffix}'


class _Reader:
    def __init__(self, text: str, base: str, name: str):
        self.base, self.prefixes, self.out, self.count, self.name = base, {}, [], 0, name
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TurtleError(f"line {text.count(chr(10), 0, at) + 1}: unexpected {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", len(text)))
        self.text, self.at = text, 0

    def fail(self, what: str):
        _, found, at = self.tokens[self.at]
        raise TurtleError(f"line {self.text.count(chr(10), 0, at) + 1}: {what}, not {found!r}")

    def next(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def peek(self) -> str:
        return self.tokens[self.at][1]

    def expect(self, mark: str):
        if self.peek() != mark:
            self.fail(f"{mark!r} expected")
        self.at += 1

    def fresh(self) -> str:
        self.count += 1
        return f"_:{self.name}{self.count}"

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            return f"<{urljoin(self.base, _unescape(text[1:-1])) if self.base else text[1:-1]}>"
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            self.at -= 1
            self.fail("a declared prefix expected")
        return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', local)}>"

    def document(self):
        while self.tokens[self.at][0] != "end":
            kind, text, _ = self.tokens[self.at]
            if text.lower() in ("@prefix", "prefix") and kind in ("at", "word"):
                self.at += 1
                name = self.next()[1]
                self.prefixes[name[:-1]] = self.iri("iri", self.next()[1])[1:-1]
            elif text.lower() in ("@base", "base") and kind in ("at", "word"):
                self.at += 1
                self.base = urljoin(self.base, self.next()[1][1:-1])
            else:
                subject = self.node()
                if self.peek() != ".":
                    self.properties(subject)
                self.expect(".")
                continue
            if text.startswith("@"):
                self.expect(".")

    def properties(self, subject: str):
        while True:
            kind, text, _ = self.next()
            if text == "a" and kind == "word":
                p = f"<{_RDF}type>"
            elif kind in ("iri", "name"):
                p = self.iri(kind, text)
            else:
                self.at -= 1
                self.fail("a predicate expected")
            while True:
                self.out.append((subject, p, self.node()))
                if self.peek() != ",":
                    break
                self.at += 1
            while self.peek() == ";":
                self.at += 1
            if self.peek() in (".", "]") or self.tokens[self.at][0] == "end":
                return
            if self.tokens[self.at - 1][1] != ";":
                self.fail("';' or '.' expected")

    def node(self) -> str:
        kind, text, _ = self.next()
        if kind in ("iri", "name"):
            return self.iri(kind, text)
        if kind == "blank":
            return f"_:{self.name}.{text[2:]}"
        if text == "[":
            own = self.fresh()
            if self.peek() != "]":
                self.properties(own)
            self.expect("]")
            return own
        if text == "(":
            items = []
            while self.peek() != ")":
                items.append(self.node())
            self.at += 1
            cells = [self.fresh() for _ in items]
            for i, (cell, item) in enumerate(zip(cells, items)):
                self.out.append((cell, f"<{_RDF}first>", item))
                self.out.append((cell, f"<{_RDF}rest>", cells[i + 1] if i + 1 < len(cells) else f"<{_RDF}nil>"))
            return cells[0] if cells else f"<{_RDF}nil>"
        if kind in ("str", "long"):
            value = _unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.tokens[self.at][0] == "at":
                return literal(value, self.next()[1])
            if self.peek() == "^^":
                self.at += 1
                datatype = self.iri(*self.next()[:2])
                return literal(value, "" if datatype == f"<{_XSD}string>" else f"^^{datatype}")
            return literal(value)
        if kind == "num":
            datatype = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return literal(text, f"^^<{_XSD}{datatype}>")
        if text in ("true", "false"):
            return literal(text, f"^^<{_XSD}boolean>")
        self.at -= 1
        self.fail("a term expected")


def parse_turtle(text: str, base: str = "", name: str = "b") -> list[tuple[str, str, str]]:
    """(s, p, o) of a document, as term text; blank nodes bear ``name``, so those of several documents stay apart."""
    reader = _Reader(text, base, name)
    reader.document()
    return list(dict.fromkeys(reader.out))


def read_turtle(spark: SparkSession, text: str, graph: str | None = None, base: str = "", name: str = "b") -> DataFrame:
    """(s, p, o, g) of one document."""
    rows = [(*t, f"<{graph}>" if graph else None) for t in parse_turtle(text, base, name)]
    return spark.createDataFrame(rows, "s string, p string, o string, g string")


def read_vocabularies(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(s, p, o, g) of all installed vocabularies, one graph for each; the first given comes first, a triple that several have counts for the first."""
    out = None
    for k, path in enumerate(paths):
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
        rows = read_turtle(spark, text, path, name=f"b{k}x").withColumn("rank", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "s string, p string, o string, g string")
    return out.groupBy("s", "p", "o").agg(F.min_by("g", "rank").alias("g"))
