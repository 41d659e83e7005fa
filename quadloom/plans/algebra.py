"""Query algebra. Expressions are tuples whose first item names the node."""

from __future__ import annotations

from dataclasses import dataclass, field

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    lex: str
    dt: str = XSD + "string"
    lang: str = ""


@dataclass(frozen=True)
class Quoted:
    """A triple term ``<<( s p o )>>``."""

    s: object
    p: object
    o: object


@dataclass(frozen=True)
class Path:
    """kind: seq, alt, inv, star, plus, opt or neg (of predicates); args are predicates or paths."""

    kind: str
    args: tuple


@dataclass(frozen=True)
class Triple:
    s: object
    p: object
    o: object


@dataclass(frozen=True)
class Op:
    """kind: bgp, join, leftjoin, union, minus, filter, extend, values, graph, service, group, project, distinct, reduced, order, slice."""

    kind: str
    args: tuple = ()
    inputs: tuple = ()


@dataclass
class Query:
    form: str
    op: Op
    template: tuple = ()
    variables: list = field(default_factory=list)


def variables(x) -> list[str]:
    """Visible variables of an operator, in order of appearance."""
    out: dict[str, None] = {}

    def term(t):
        if isinstance(t, Var):
            out[t.name] = None
        elif isinstance(t, (Triple, Quoted)):
            for y in (t.s, t.p, t.o):
                term(y)

    def walk(op: Op):
        if op.kind == "project":
            out.update(dict.fromkeys(op.args[0]))
            return
        if op.kind == "group":
            out.update(dict.fromkeys([n for n, _ in op.args[0]] + [n for n, _ in op.args[1]]))
            return
        if op.kind == "bgp":
            for t in op.args:
                term(t)
        for y in op.inputs[:1] if op.kind == "minus" else op.inputs:
            walk(y)
        if op.kind == "extend":
            out[op.args[0]] = None
        elif op.kind == "values":
            out.update(dict.fromkeys(op.args[0]))
        elif op.kind == "graph":
            term(op.args[0])

    walk(x)
    return [v for v in out if not v.startswith(".")]
