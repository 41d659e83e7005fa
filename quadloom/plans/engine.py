"""The query interface: text in, DataFrame out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions.extract import first_fence, split_frontmatter
from .algebra import Query
from .dataset import Dataset
from .params import Parameter, bind, declare
from .parser import ParseError, parse
from .planner import Planner

# fixed values: the vocabularies every query may name
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "sh": "http://www.w3.org/ns/shacl#",
}


class Engine:
    def __init__(self, data: Dataset, prefixes: dict[str, str] | None = None):
        self.data = data
        self.prefixes = PREFIXES | {"": data.base} | (prefixes or {})
        self.saved: dict[str, tuple[str, list[Parameter]]] = {}

    def inject(self, text: str) -> dict[str, str]:
        """Known prefixes that the text uses and does not declare."""
        declared = {m.lower() for m in re.findall(r"(?i)\bPREFIX\s+([\w.-]*):", text)}
        return {k: v for k, v in self.prefixes.items() if k.lower() not in declared and f"{k}:" in text}

    def parse(self, text: str) -> Query:
        try:
            return parse(text, self.inject(text), self.data.base)
        except ParseError as e:
            missing = [p for p in re.findall(r"(?<![\w<])([A-Za-z][\w-]*):[A-Za-z]", text) if p not in self.inject(text)]
            hint = f" (known prefixes: {', '.join(sorted(k for k in self.prefixes if k))})" if missing and "prefix" in str(e) else ""
            raise ParseError(f"{e}{hint}") from None

    def query(self, text: str, declared: list[str] | None = None, **given: str) -> DataFrame:
        q = self.parse(text)
        if declared or given:
            q = bind(q, [declare(d) for d in declared or []], given)
        return Planner(self.data).run(q)

    # saved queries
    def save(self, name: str, document: str, declared: list[str] | None = None) -> None:
        """Registers ``kit/name`` or ``name``; the query is the document's first fenced block."""
        block = first_fence(split_frontmatter(document)[1])
        if block is None:
            raise ValueError(f"{name}: the document has no fenced block")
        self.saved[name] = (block, [declare(d) for d in declared or []])

    def lookup(self, name: str) -> tuple[str, list[Parameter]]:
        found = [k for k in self.saved if k == name] or [k for k in self.saved if k.rpartition("/")[2] == name]
        if not found:
            raise KeyError(f"no saved query {name!r}")
        if len(found) > 1:
            raise KeyError(f"{name!r} is ambiguous: {', '.join(sorted(found))}")
        return self.saved[found[0]]

    def run_saved(self, name: str, **given: str) -> DataFrame:
        text, declared = self.lookup(name)
        q = self.parse(text)
        return Planner(self.data).run(bind(q, declared, given) if declared or given else q)
