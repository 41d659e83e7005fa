"""Algebra to DataFrame. Catalyst picks the physical plan.

* Patterns that share a subject and whose predicates are columns of one table
  are one scan of that table (star merge), never self-joins.
* For every variable the planner knows whether it is certainly bound. Shared
  certain variables join by plain equality; only those that may be unbound take
  the null-tolerant condition that the query language asks for.
* Path closures double the length of the paths they know with each round, so a
  chain of n links takes log2(n) rounds; where an end is given, only what that
  end reaches is kept. Rounds are written to the shared checkpoint folder, so
  their lineage stays short.
* Under an aggregate, sides that match many to many are counted before they are
  joined: a row of distinct values carries how many it stands for (``.w``).
* Tables are read as stars only where no stored quad or described graph can add
  to or hide their triples.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from .algebra import RDF_TYPE, XSD, Iri, Lit, Op, Path, Quoted, Query, Triple, Var, variables
from .dataset import NUMERIC, Dataset, Table


class Unsupported(ValueError):
    pass


@dataclass(frozen=True)
class Info:
    kind: str
    certain: bool = True


@dataclass
class Rel:
    df: DataFrame
    vars: dict[str, Info]
    #: variables of which a value has one row at most, if known
    key: frozenset[str] | None = None

    def col(self, name: str) -> Column:
        return self.df[cid(name)]


def cid(name: str) -> str:
    return "v_" + name.replace(".", "__")


def const_text(t) -> str:
    if isinstance(t, Iri):
        return f"<{t.value}>"
    if isinstance(t, Quoted):
        return f"<<( {const_text(t.s)} {const_text(t.p)} {const_text(t.o)} )>>"
    return T.literal_text(t.lex, t.dt, t.lang)


_CASTS = {"integer": "bigint", "decimal": "decimal(38,10)", "double": "double", "boolean": "boolean", "date": "date", "dateTime": "timestamp_ntz", "string": "string"}


class Planner:
    def __init__(self, data: Dataset):
        self.data, self.spark, self.fresh = data, data.spark, count()
        #: variable -> how its STR starts, by a filter around what is being planned
        self.starts: dict[str, str] = {}

    # constants
    def constant(self, t) -> tuple[Column, str]:
        if isinstance(t, Lit) and t.dt.startswith(XSD) and not t.lang:
            kind = {"float": "double", "int": "integer", "long": "integer"}.get(t.dt[len(XSD):], t.dt[len(XSD):])
            if kind in _CASTS:
                return F.lit(t.lex) if kind == "string" else F.lit(t.lex).cast(_CASTS[kind]), kind
        return F.lit(const_text(t)), "term"

    def key_of(self, iri: str, kind: str) -> Column | None:
        """The native key that an IRI stands for, if it is one of that class."""
        name = kind[7:]
        start = f"{self.data.base}{name}/"
        if not iri.startswith(start):
            return None
        key = self.data.tables[name].key
        return F.lit(iri[len(start):]).cast(self.data.tables[name].df.schema[key[0]].dataType if len(key) == 1 else "string")

    def equal(self, a: tuple[Column, str], b: tuple[Column, str]) -> Column:
        """sameTerm for joins."""
        (x, k), (y, j) = a, b
        if k == j or k in NUMERIC and j in NUMERIC:
            return x == y
        if k.startswith("entity:") and j.startswith("entity:"):
            return F.lit(False)
        return self.data.text(x, k) == self.data.text(y, j)

    # patterns
    def empty(self) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(1).alias("_")), {})

    def plan(self, op: Op, graph=None) -> Rel:
        return getattr(self, "_" + op.kind)(op, graph)

    def _bgp(self, op: Op, graph, needed: set[str] | None = None) -> Rel:
        """With ``needed``, the variables that an aggregate looks at, rows may carry a weight instead of being repeated."""
        stars: dict = {}
        rest = []
        for t in op.args:
            plain = isinstance(t.p, Iri) and isinstance(t.s, (Var, Iri)) and not isinstance(t.o, Quoted) and graph is None and self.data.tables and self.data.quads is None and not self.data.catalog
            known = plain and (t.p.value in self.data.predicates or t.p.value == RDF_TYPE and isinstance(t.o, Iri) and t.o.value.startswith(self.data.base) and t.o.value[len(self.data.base):] in self.data.tables)
            if known:
                table = self.data.predicates[t.p.value][0] if t.p.value != RDF_TYPE else t.o.value[len(self.data.base):]
                stars.setdefault((t.s, table), []).append(t)
            else:
                rest.append(t)
        rels = [self.star(s, table, ts) for (s, table), ts in stars.items()]
        rels += [self.pattern(t, graph) for t in rest]
        if not rels:
            return self.empty()
        # joined in an order in which each shares a variable with what is there, if any does
        out = rels.pop(0)
        while rels:
            k = next((i for i, r in enumerate(rels) if set(r.vars) & set(out.vars)), 0)
            nxt = rels.pop(k)
            if needed is None:
                out = self.join(out, nxt)
            else:
                out = self.weighed_join(out, nxt, needed.union(*(r.vars for r in rels)))
        return out

    def weighed(self, op: Op, graph, needed: set[str]) -> Rel:
        """The plan of an aggregate's input; its rows have a weight (``.w``) where that saves repeating them."""
        if op.kind == "bgp":
            return self._bgp(op, graph, needed)
        if op.kind == "filter" and not self.has_exists(op.args[0]):
            return self._filter(op, graph, lambda x, g: self.weighed(x, g, needed | set(self.mentions(op.args[0]))))
        if op.kind == "extend" and not self.has_exists(op.args[1]):
            return self._extend(op, graph, self.weighed(op.inputs[0], graph, needed | set(self.mentions(op.args[1]))))
        if op.kind == "join":
            inner = needed | set(variables(op.inputs[0])) & set(variables(op.inputs[1]))
            return self.weighed_join(*(self.weighed(x, graph, inner) for x in op.inputs), needed)
        return self.plan(op, graph)

    def weighed_join(self, a: Rel, b: Rel, needed: set[str]) -> Rel:
        shared = {n for n in a.vars if n in b.vars and n != ".w"}
        one_a, one_b = (r.key is not None and r.key <= shared for r in (a, b))
        if not one_a and not one_b:
            a, b = self.thin(a, needed | shared), self.thin(b, needed | shared)
        key = a.key if one_b else b.key if one_a else None if a.key is None or b.key is None else a.key | b.key
        if ".w" in a.vars and ".w" in b.vars:
            r = self.join(self.rename(a, {".w": ".wa"}), self.rename(b, {".w": ".wb"}))
            names = [n for n in r.vars if n not in (".wa", ".wb")]
            return Rel(r.df.select(*(cid(n) for n in names), (r.col(".wa") * r.col(".wb")).alias(cid(".w"))), {n: r.vars[n] for n in names} | {".w": Info("integer")}, key)
        r = self.join(a, b)
        return Rel(r.df, r.vars, key)

    def thin(self, r: Rel, names: set[str]) -> Rel:
        """One row for each combination of the values of ``names``, with its weight."""
        kept = [n for n in r.vars if n in names and n != ".w"]
        if r.key is not None and r.key <= set(kept) or not all(r.vars[n].certain for n in kept):
            return r
        w = F.sum(r.col(".w")) if ".w" in r.vars else F.count(F.lit(1))
        df = r.df.groupBy(*(cid(n) for n in kept)).agg(w.alias(cid(".w"))).where(F.col(cid(".w")) > 0)
        return Rel(df, {n: r.vars[n] for n in kept} | {".w": Info("integer")}, frozenset(kept))

    def star(self, subject, name: str, ts: list[Triple]) -> Rel:
        table = self.data.tables[name]
        df, out, conds, info = table.df, {}, [], {}

        def bind(term, column: Column, kind: str):
            if isinstance(term, Var):
                if term.name in out:
                    conds.append(self.equal((column, kind), (out[term.name], info[term.name].kind)))
                else:
                    out[term.name], info[term.name] = column, Info(kind)
            elif isinstance(term, Iri):
                key = self.key_of(term.value, kind) if kind.startswith("entity:") else None
                conds.append(F.lit(False) if key is None else column == key)
            else:
                value, k = self.constant(term)
                conds.append(self.equal((column, kind), (value, k)))

        bind(subject, table.subject(), "entity:" + name)
        for t in ts:
            if t.p.value == RDF_TYPE:
                continue
            c = self.data.predicates[t.p.value][1]
            if c not in table.key:
                conds.append(F.col(c).isNotNull())
            bind(t.o, F.col(c), table.kind(c))
        for c in conds:
            df = df.where(c)
        one = (frozenset((subject.name,)) if isinstance(subject, Var) else frozenset()) if len(table.key) == 1 else None
        return Rel(df.select(F.lit(1).alias("_"), *(c.alias(cid(n)) for n, c in out.items())).drop("_") if out else df.select(F.lit(1).alias("_")), info, one)

    def pattern(self, t: Triple, graph) -> Rel:
        if isinstance(t.p, Path):
            return self.path(t, graph)
        where = graph.value if isinstance(graph, Iri) else "*" if graph is not None else None
        rows = self.data.scan(where)
        out, seen = [], {}
        parts = [(t.s, "s"), (t.p, "p"), (t.o, "o")] + ([(graph, "g")] if isinstance(graph, Var) else [])
        for term, c in parts:
            if isinstance(term, Var):
                if term.name in seen:
                    rows = rows.where(F.col(c) == F.col(seen[term.name]))
                else:
                    seen[term.name] = c
                    out.append(F.col(c).alias(cid(term.name)))
            elif isinstance(term, Quoted):
                # term text of a triple term: <<( s p o )>>, taken apart
                m = r"(?s)^<<\( (\S+) (<[^>]*>) (.*) \)>>$"
                rows = rows.where(F.col(c).startswith("<<("))
                for k, inner in enumerate((term.s, term.p, term.o)):
                    piece = F.regexp_extract(c, m, k + 1)
                    if isinstance(inner, Var):
                        if inner.name in seen:
                            rows = rows.where(piece == F.col(seen[inner.name]))
                        else:
                            rows = rows.withColumn(f"q{k}{c}", piece)
                            seen[inner.name] = f"q{k}{c}"
                            out.append(F.col(f"q{k}{c}").alias(cid(inner.name)))
                    else:
                        rows = rows.where(piece == const_text(inner))
            else:
                rows = rows.where(F.col(c) == const_text(term))
        return Rel(rows.select(*out) if out else rows.select(F.lit(1).alias("_")), {n: Info("term") for n in seen})

    # paths
    def edges(self, p, graph) -> Rel:
        """(.s, .o) pairs of a path."""
        s, o = Var(".s"), Var(".o")
        if isinstance(p, Iri):
            return self._bgp(Op("bgp", (Triple(s, p, o),)), graph)
        a = p.args
        if p.kind == "inv":
            e = self.edges(a[0], graph)
            return Rel(e.df.select(e.col(".o").alias(cid(".s")), e.col(".s").alias(cid(".o"))), {".s": e.vars[".o"], ".o": e.vars[".s"]})
        if p.kind == "seq":
            out = self.edges(a[0], graph)
            for q in a[1:]:
                nxt = self.rename(self.edges(q, graph), {".s": ".o", ".o": ".t"})
                j = self.join(out, nxt)
                out = Rel(j.df.select(j.col(".s"), j.col(".t").alias(cid(".o"))), {".s": j.vars[".s"], ".o": j.vars[".t"]})
            return out
        if p.kind == "alt":
            return reduce(self.union, [self.edges(q, graph) for q in a])
        if p.kind == "neg":
            return self.negated(p, graph)
        e = self.edges(a[0], graph)
        kind = e.vars[".s"].kind if e.vars[".s"].kind == e.vars[".o"].kind else "term"
        base = e.df.select(self.to(e, ".s", kind).alias("s"), self.to(e, ".o", kind).alias("o")).distinct()
        pairs = base if p.kind == "opt" else self.closure(base)
        if p.kind in ("star", "opt"):
            nodes = self.nodes(graph, kind)
            pairs = pairs.union(nodes.select("n", "n")).distinct()
        return Rel(pairs.select(F.col("s").alias(cid(".s")), F.col("o").alias(cid(".o"))), {".s": Info(kind), ".o": Info(kind)})

    def negated(self, p, graph, s_start: str = "", o_start: str = "") -> Rel:
        """(.s, .o) of a negated set; what a filter says of the ends and which predicates are out limits what is read."""
        fwd = [q for q in p.args if isinstance(q, Iri)]
        back = [q.args[0] for q in p.args if isinstance(q, Path)]
        where = graph.value if isinstance(graph, Iri) else "*" if graph is not None else None

        def without(names, ends, *starts):
            names = tuple(n.value for n in names)
            rows = self.data.scan(where, names, *starts).where(~F.col("p").isin([f"<{n}>" for n in names]))
            return Rel(rows.select(*(F.col(c).alias(cid(n)) for c, n in zip("so", ends))), {n: Info("term") for n in ends})

        parts = [without(fwd, (".s", ".o"), s_start, o_start)] if fwd or not back else []
        if back:
            parts.append(without(back, (".o", ".s"), o_start, s_start))
        return reduce(self.union, parts)

    def nodes(self, graph, kind: str) -> DataFrame:
        """Zero-length paths: every subject and object, or every row of the class that the path stays in."""
        if kind.startswith("entity:"):
            return self.data.tables[kind[7:]].df.select(self.data.tables[kind[7:]].subject().alias("n"))
        where = graph.value if isinstance(graph, Iri) else "*" if graph is not None else None
        rows = self.data.scan(where)
        return rows.select(F.col("s").alias("n")).union(rows.select("o")).distinct()

    def closure(self, base: DataFrame) -> DataFrame:
        """All pairs: after each round, those of paths twice as long."""
        known = self.cut(base)
        n = known.count()
        while True:
            step = known.select(F.col("s").alias("o"), F.col("o").alias("t"))
            known = self.cut(known.union(known.join(step, "o").select("s", F.col("t").alias("o"))).distinct())
            before, n = n, known.count()
            if n == before:
                return known

    def reach(self, base: DataFrame, start: str) -> DataFrame:
        """(n): what paths of any length, zero included, reach from one node. A round looks twice as far as the one before;
        when it finds nothing new, there is no node at exactly that distance and so none beyond."""
        found = self.spark.range(1).select(F.lit(start).alias("n"))
        step, n = self.cut(base.distinct()), 1
        while True:
            further = found.join(step, F.col("n") == F.col("s")).select(F.col("o").alias("n"))
            found = self.cut(found.union(further).distinct())
            before, n = n, found.count()
            if n == before:
                return found
            other = step.select(F.col("s").alias("o"), F.col("o").alias("t"))
            step = self.cut(step.join(other, "o").select("s", F.col("t").alias("o")).distinct())

    def bound_path(self, t: Triple, graph) -> Rel:
        """A repeated path of which an end is given; a path of no length reaches a term that the graph does not have."""
        e = self.edges(t.p.args[0], graph)
        base = e.df.select(self.to(e, ".s", "term").alias("s"), self.to(e, ".o", "term").alias("o"))
        near, far = (t.s, t.o) if not isinstance(t.s, Var) else (t.o, t.s)
        if near is t.o:
            base = base.select(F.col("o").alias("s"), F.col("s").alias("o"))
        start = const_text(near)
        if t.p.kind == "opt":
            out = base.where(F.col("s") == start).select(F.col("o").alias("n")).union(self.spark.range(1).select(F.lit(start).alias("n")))
        else:
            out = self.reach(base, start)
            if t.p.kind == "plus":
                out = base.join(out, F.col("s") == F.col("n"), "left_semi").select(F.col("o").alias("n"))
        out = out.distinct()
        if isinstance(far, Var):
            return Rel(out.select(F.col("n").alias(cid(far.name))), {far.name: Info("term")})
        return Rel(out.where(F.col("n") == const_text(far)).select(F.lit(1).alias("_")), {})

    def cut(self, df: DataFrame) -> DataFrame:
        context = self.spark.sparkContext
        if context.getCheckpointDir() is None:
            import tempfile

            given = self.spark.conf.get("spark.checkpoint.dir", None)
            if given is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            context.setCheckpointDir(given or "file://" + tempfile.mkdtemp(prefix="quadloom-"))
        return df.checkpoint()

    def path(self, t: Triple, graph) -> Rel:
        if t.p.kind == "seq" and all(isinstance(x, (Iri, Path)) for x in t.p.args):
            # a sequence is its parts with fresh variables between: the star merge sees through it
            mid = [t.s, *(Var(f".m{next(self.fresh)}") for _ in t.p.args[1:]), t.o]
            r = self._bgp(Op("bgp", tuple(Triple(a, p, b) for a, p, b in zip(mid, t.p.args, mid[1:]))), graph)
            return self.keep(r, [n for n in r.vars if not n.startswith(".m")])
        if t.p.kind == "inv":
            return self._bgp(Op("bgp", (Triple(t.o, t.p.args[0], t.s),)), graph)
        if t.p.kind in ("star", "plus", "opt") and not (isinstance(t.s, Var) and isinstance(t.o, Var)):
            return self.bound_path(t, graph)
        ends = [self.starts.get(x.name, "") if isinstance(x, Var) else "" for x in (t.s, t.o)]
        e = self.negated(t.p, graph, *ends) if t.p.kind == "neg" else self.edges(t.p, graph)
        rel = self.rename(e, {".s": ".ps", ".o": ".po"})
        for term, name in ((t.s, ".ps"), (t.o, ".po")):
            if isinstance(term, Var):
                if term.name in rel.vars:
                    rel = Rel(rel.df.where(self.equal((rel.col(term.name), rel.vars[term.name].kind), (rel.col(name), rel.vars[name].kind))).drop(cid(name)), {k: v for k, v in rel.vars.items() if k != name})
                else:
                    rel = self.rename(rel, {name: term.name})
            else:
                kind = rel.vars[name].kind
                key = self.key_of(term.value, kind) if isinstance(term, Iri) and kind.startswith("entity:") else None
                cond = rel.col(name) == key if key is not None else self.data.text(rel.col(name), kind) == const_text(term)
                rel = Rel(rel.df.where(cond).drop(cid(name)), {k: v for k, v in rel.vars.items() if k != name})
        return rel

    # relational helpers
    def rename(self, r: Rel, names: dict[str, str]) -> Rel:
        return Rel(r.df.select(*(r.col(n).alias(cid(names.get(n, n))) for n in r.vars)), {names.get(n, n): i for n, i in r.vars.items()})

    def keep(self, r: Rel, names: list[str]) -> Rel:
        return Rel(r.df.select(*(cid(n) for n in names)) if names else r.df.select(F.lit(1).alias("_")), {n: r.vars[n] for n in names})

    def to(self, r: Rel, name: str, kind: str) -> Column:
        own = r.vars[name].kind
        if own == kind:
            return r.col(name)
        if own in NUMERIC and kind in NUMERIC:
            return r.col(name).cast(_CASTS[kind])
        return self.data.text(r.col(name), own)

    def common(self, a: Info, b: Info) -> str:
        if a.kind == b.kind:
            return a.kind
        if a.kind in NUMERIC and b.kind in NUMERIC:
            return NUMERIC[max(NUMERIC.index(a.kind), NUMERIC.index(b.kind))]
        return "term"

    def as_common(self, a: Rel, b: Rel) -> tuple[Rel, Rel]:
        """Both with shared variables of one kind; the right's under names of their own."""
        shared = [n for n in a.vars if n in b.vars]
        kinds = {n: self.common(a.vars[n], b.vars[n]) for n in shared}
        x = Rel(a.df.select(*(self.to(a, n, kinds.get(n, i.kind)).alias(cid(n)) for n, i in a.vars.items())) if a.vars else a.df, {n: Info(kinds.get(n, i.kind), i.certain) for n, i in a.vars.items()})
        y = Rel(b.df.select(*(self.to(b, n, kinds.get(n, i.kind)).alias(cid(n) + ("_r" if n in shared else "")) for n, i in b.vars.items())) if b.vars else b.df, {n: Info(kinds.get(n, i.kind), i.certain) for n, i in b.vars.items()})
        return x, y

    def compatible(self, a: Rel, b: Rel, shared) -> Column:
        conds = []
        for n in shared:
            x, y = F.col(cid(n)), F.col(cid(n) + "_r")
            c = x == y
            if not a.vars[n].certain:
                c = c | x.isNull()
            if not b.vars[n].certain:
                c = c | y.isNull()
            conds.append(c)
        return reduce(lambda p, q: p & q, conds, F.lit(True)) if conds else F.lit(True)

    def join(self, a: Rel, b: Rel, how: str = "inner", conds=()) -> Rel:
        shared = [n for n in a.vars if n in b.vars]
        x, y = self.as_common(a, b)
        df_r = y.df
        on = self.compatible(x, y, shared)
        if conds:
            scope = {n: (F.col(cid(n)), i.kind) for n, i in x.vars.items()}
            scope |= {n: (F.col(cid(n)), i.kind) for n, i in y.vars.items() if n not in shared}
            for n in shared:
                if not x.vars[n].certain:
                    scope[n] = (F.coalesce(F.col(cid(n)), F.col(cid(n) + "_r")), x.vars[n].kind)
            for c in conds:
                on = on & self.truth(self.expr(c, scope))
        left = x.df if a.vars else x.df.select("_")
        right = df_r if b.vars else df_r.select(F.lit(1).alias("__"))
        joined = left.join(right, on, how) if shared or conds or how != "inner" else left.crossJoin(right)
        cols, info = [], {}
        for n, i in x.vars.items():
            c = F.col(cid(n))
            if n in shared and not i.certain:
                c = F.coalesce(c, F.col(cid(n) + "_r"))
            cols.append(c.alias(cid(n)))
            info[n] = Info(i.kind, i.certain or n in shared and y.vars[n].certain and how == "inner")
        for n, i in y.vars.items():
            if n not in shared:
                cols.append(F.col(cid(n)))
                info[n] = Info(i.kind, i.certain and how == "inner")
        return Rel(joined.select(*cols) if cols else joined, info)

    def union(self, a: Rel, b: Rel) -> Rel:
        x, y = self.as_common(a, b)
        shared = [n for n in a.vars if n in b.vars]
        y = Rel(y.df.select(*(F.col(cid(n) + ("_r" if n in shared else "")).alias(cid(n)) for n in y.vars)) if y.vars else y.df, y.vars)
        info = {n: Info((x.vars.get(n) or y.vars[n]).kind, n in shared and x.vars[n].certain and y.vars[n].certain) for n in [*x.vars, *(m for m in y.vars if m not in x.vars)]}
        return Rel(x.df.unionByName(y.df, allowMissingColumns=True), info)

    # operators
    def _join(self, op, graph):
        return self.join(self.plan(op.inputs[0], graph), self.plan(op.inputs[1], graph))

    def _leftjoin(self, op, graph):
        return self.join(self.plan(op.inputs[0], graph), self.plan(op.inputs[1], graph), "left", op.args)

    def _union(self, op, graph):
        return self.union(self.plan(op.inputs[0], graph), self.plan(op.inputs[1], graph))

    def _minus(self, op, graph):
        a, b = self.plan(op.inputs[0], graph), self.plan(op.inputs[1], graph)
        shared = [n for n in a.vars if n in b.vars]
        if not shared:
            return a
        return self.restrict(a, self.keep(b, shared), "left_anti", overlap=True)

    def restrict(self, a: Rel, b: Rel, how: str, overlap: bool = False, conds=()) -> Rel:
        x, y = self.as_common(a, b)
        shared = [n for n in a.vars if n in b.vars]
        on = self.compatible(x, y, shared)
        if overlap and not all(x.vars[n].certain and y.vars[n].certain for n in shared):
            on = on & reduce(lambda p, q: p | q, [F.col(cid(n)).isNotNull() & F.col(cid(n) + "_r").isNotNull() for n in shared])
        if conds:
            scope = {n: (F.col(cid(n)), i.kind) for n, i in [*x.vars.items(), *((m, j) for m, j in y.vars.items() if m not in shared)]}
            for c in conds:
                on = on & self.truth(self.expr(c, scope))
        right = y.df if b.vars else y.df.select(F.lit(1).alias("__"))
        return Rel(x.df.join(right, on, how), x.vars)

    def _filter(self, op, graph, plan=None):
        e, parts = op.args[0], []

        def split(x):
            if x[0] == "&&":
                split(x[1]), split(x[2])
            else:
                parts.append(x)

        split(e)
        kept = self.starts
        # within one group only: elsewhere a variable of that name may be another, or unbound
        self.starts = {}
        if op.inputs[0].kind == "bgp":
            for x in parts:
                match x:
                    case ("call", "STRSTARTS", (("call", "STR", (("var", name),)), ("term", Lit() as start))) if start.dt == XSD + "string":
                        self.starts[name] = max(self.starts.get(name, ""), start.lex, key=len)
        rel = (plan or self.plan)(op.inputs[0], graph)
        self.starts = kept
        for x in parts:
            if x[0] == "exists":
                rel = self.exists(rel, x[1], "left_semi", graph)
            elif x[0] == "!" and x[1][0] == "exists":
                rel = self.exists(rel, x[1][1], "left_anti", graph)
            else:
                rel, x = self.marked(rel, x, graph)
                rel = Rel(rel.df.where(self.truth(self.expr(x, self.scope(rel)))), rel.vars)
        return rel

    def exists(self, rel: Rel, pattern: Op, how: str, graph) -> Rel:
        conds = []
        inner = pattern
        while inner.kind == "filter" and not set(self.mentions(inner.args[0])) <= set(variables(inner.inputs[0])):
            conds.append(inner.args[0])
            inner = inner.inputs[0]
        return self.restrict(rel, self.plan(inner, graph), how, conds=conds)

    def mentions(self, e) -> list[str]:
        if isinstance(e, (tuple, list)):
            return [e[1]] if e[:1] == ("var",) else [v for x in e for v in self.mentions(x)]
        return []

    def has_exists(self, e) -> bool:
        return isinstance(e, (tuple, list)) and (e[:1] == ("exists",) or any(self.has_exists(x) for x in e))

    def marked(self, rel: Rel, e, graph):
        """EXISTS within a larger expression becomes a column that tells."""
        if not isinstance(e, tuple) or not e:
            return rel, e
        if e[0] == "exists":
            if e[1].kind == "filter" and not set(self.mentions(e[1].args[0])) <= set(variables(e[1].inputs[0])):
                # the pattern's filter looks at outer variables: rows are numbered, and those that pass are marked
                row, name = f".r{next(self.fresh)}", f".x{next(self.fresh)}"
                numbered = Rel(self.cut(rel.df.withColumn(cid(row), F.monotonically_increasing_id())), rel.vars | {row: Info("integer")})
                passed = self.exists(numbered, e[1], "left_semi", graph).df.select(F.col(cid(row)).alias("_row")).withColumn(cid(name), F.lit(True))
                df = numbered.df.join(passed, numbered.df[cid(row)] == passed["_row"], "left").drop("_row", cid(row))
                return Rel(df, rel.vars | {name: Info("boolean", False)}), ("call", "COALESCE", (("var", name), ("term", Lit("false", XSD + "boolean"))))
            inner = self.plan(e[1], graph)
            shared = [n for n in rel.vars if n in inner.vars]
            name = f".x{next(self.fresh)}"
            mark = self.keep(inner, shared)
            mark = Rel(mark.df.distinct().withColumn(cid(name), F.lit(True)), mark.vars | {name: Info("boolean")})
            return self.join(rel, mark, "left"), ("call", "COALESCE", (("var", name), ("term", Lit("false", XSD + "boolean"))))
        out = []
        for x in e:
            if isinstance(x, tuple):
                rel, x = self.marked(rel, x, graph)
            out.append(x)
        return rel, tuple(out)

    def _graph(self, op, graph):
        name = op.args[0]
        return self.plan(op.inputs[0], name)

    def _service(self, op, graph):
        raise Unsupported("SERVICE is not supported: this engine asks no other endpoint")

    def scope(self, r: Rel) -> dict[str, tuple[Column, str]]:
        return {n: (r.col(n), i.kind) for n, i in r.vars.items()}

    def _extend(self, op, graph, r: Rel | None = None):
        r = self.plan(op.inputs[0], graph) if r is None else r
        r, e = self.marked(r, op.args[1], graph)
        c, kind = self.expr(e, self.scope(r))
        certain = e[0] == "term" or e[0] == "var" and e[1] in r.vars and r.vars[e[1]].certain
        return Rel(r.df.withColumn(cid(op.args[0]), c), r.vars | {op.args[0]: Info(kind, certain)})

    def _values(self, op, graph):
        names, rows = op.args
        columns, info = [], {}
        for i, n in enumerate(names):
            kinds = {self.constant(r[i])[1] for r in rows if r[i] is not None}
            kind = kinds.pop() if len(kinds) == 1 else "term"
            info[n] = Info(kind, all(r[i] is not None for r in rows))
        out = None
        for r in rows:
            cells = []
            for n, t in zip(names, r):
                c = F.lit(None).cast(_CASTS.get(info[n].kind, "string")) if t is None else self.constant(t)[0] if info[n].kind != "term" else F.lit(const_text(t))
                cells.append(c.alias(cid(n)))
            cells = F.struct(*cells)
            columns.append(cells)
        if not columns:
            return Rel(self.spark.range(0).select(*(F.lit(None).cast("string").alias(cid(n)) for n in names)), info)
        out = self.spark.range(1).select(F.explode(F.array(*columns)).alias("r")).select("r.*")
        return Rel(out, info)

    def _project(self, op, graph):
        r = self.plan(op.inputs[0], graph)
        df, info = r.df, dict(r.vars)
        for n in op.args[0]:
            if n not in info:
                df, info[n] = df.withColumn(cid(n), F.lit(None).cast("string")), Info("term", False)
        return self.keep(Rel(df, info), list(dict.fromkeys(op.args[0])))

    def _distinct(self, op, graph):
        r = self.plan(op.inputs[0], graph)
        return Rel(r.df.distinct(), r.vars)

    def _reduced(self, op, graph):
        return self.plan(op.inputs[0], graph)

    def _order(self, op, graph):
        r = self.plan(op.inputs[0], graph)
        keys = []
        for way, e in op.args:
            c, kind = self.expr(e, self.scope(r))
            # unbound, blank, IRI, literal; numbers by value
            cs = [F.when(c.isNull(), 0).when(T.is_blank(c), 1).when(T.is_iri(c), 2).otherwise(3), T.number(c), T.lex(c)] if kind == "term" else [c]
            keys += [x.desc_nulls_last() if way == "DESC" else x.asc_nulls_first() for x in cs]
        return Rel(r.df.orderBy(*keys), r.vars)

    def _slice(self, op, graph):
        r = self.plan(op.inputs[0], graph)
        df = r.df.offset(op.args[0]) if op.args[0] else r.df
        return Rel(df if op.args[1] is None else df.limit(op.args[1]), r.vars)

    def _group(self, op, graph):
        exprs = [e for _, e in op.args[0]] + [a[3] for _, a in op.args[1] if a[3] is not None]
        repeats = any(a[1] == "GROUP_CONCAT" and not a[2] or a[1] == "COUNT" and a[2] and a[3] is None for _, a in op.args[1])
        if repeats or any(self.has_exists(e) for e in exprs):
            r = self.plan(op.inputs[0], graph)
        else:
            r = self.weighed(op.inputs[0], graph, {v for e in exprs for v in self.mentions(e)})
            sums = [self.expr(a[3], self.scope(r))[1] for _, a in op.args[1] if a[1] in ("SUM", "AVG") and not a[2]]
            if ".w" in r.vars and "decimal" in sums:  # a product of decimals may lose digits
                r = self.plan(op.inputs[0], graph)
        scope = self.scope(r)
        keys, info = [], {}
        for n, e in op.args[0]:
            c, kind = self.expr(e, scope)
            keys.append(c.alias(cid(n)))
            info[n] = Info(kind, e[0] == "var" and e[1] in r.vars and r.vars[e[1]].certain)
        aggs = []
        for n, (_, name, distinct, e, sep) in op.args[1]:
            c, kind, certain = self.aggregate(name, distinct, e, sep, scope, r)
            aggs.append(c.alias(cid(n)))
            info[n] = Info(kind, certain)
        if not aggs:
            return Rel(r.df.select(*keys).distinct(), info)
        return Rel(r.df.groupBy(*keys).agg(*aggs), info)

    def aggregate(self, name, distinct, e, sep, scope, r):
        w = r.col(".w") if ".w" in r.vars and not distinct else None
        if name == "COUNT" and w is not None:
            w = w if e is None else F.when(self.expr(e, scope)[0].isNotNull(), w)
            return F.coalesce(F.sum(w), F.lit(0)), "integer", True
        if name == "COUNT":
            if e is None:
                c = F.count_distinct(F.struct(*(F.col(cid(n)) for n in r.vars))) if distinct else F.count(F.lit(1))
            else:
                c, _ = self.expr(e, scope)
                c = F.count_distinct(c) if distinct else F.count(c)
            return c, "integer", True
        c, kind = self.expr(e, scope)
        if name in ("SUM", "AVG"):
            wrong = F.lit(False)  # one value that is no number leaves the whole unbound
            if kind == "term":
                wrong = F.count_if(c.isNotNull() & T.number(c).isNull()) > 0
                c, kind = T.number(c), "double"
            if kind not in NUMERIC:
                return F.when(F.count(c) == 0, F.lit(0.0)), "double", False
            f = (F.sum_distinct if distinct else F.sum) if name == "SUM" else (lambda x: F.sum_distinct(x) / F.count_distinct(x) if distinct else F.avg(x))
            if w is not None:
                # a value's weight in the sum is exact for whole numbers; the average divides by all weights
                f = (lambda x: F.sum(x * w)) if name == "SUM" else (lambda x: F.sum(x.cast("double") * w) / F.sum(F.when(x.isNotNull(), w)))
            kind = kind if name == "SUM" else "double"
            return F.when(~wrong, F.coalesce(f(c), F.lit(0).cast(_CASTS[kind])).cast(_CASTS[kind])), kind, False
        if name in ("MIN", "SAMPLE"):
            return F.min(c), kind, False
        if name == "MAX":
            return F.max(c), kind, False
        text = self.string(c, kind)
        return (F.array_join(F.array_sort(F.collect_set(text) if distinct else F.collect_list(text)), sep)), "string", False

    # expressions
    def truth(self, x: tuple[Column, str]) -> Column:
        """Effective boolean value; an error is null and so drops the row."""
        c, kind = x
        if kind == "boolean":
            return c
        if kind in NUMERIC:
            return c != 0
        if kind == "string":
            return c != ""
        if kind == "term":
            return F.when(T.datatype(c) == XSD + "boolean", T.lex(c) == "true").when(T.number(c).isNotNull(), T.number(c) != 0).when(T.datatype(c) == XSD + "string", T.lex(c) != "")
        return F.lit(None).cast("boolean")

    def string(self, c: Column, kind: str) -> Column:
        if kind == "term":
            return T.lex(c)
        if kind.startswith("entity:"):
            return T.lex(self.data.text(c, kind))
        if kind == "dateTime":
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return c.cast("string")

    def num(self, x):
        c, kind = x
        if kind in NUMERIC:
            return c, kind
        return (T.number(c), "double") if kind == "term" else (F.lit(None).cast("double"), "double")

    def compare(self, sign: str, a, b) -> Column:
        (x, k), (y, j) = a, b
        if k in NUMERIC or j in NUMERIC:
            x, y = self.num(a)[0], self.num(b)[0]
        elif k.startswith("entity:") or j.startswith("entity:"):
            x, y = self.data.text(x, k), self.data.text(y, j)
        elif k != j and "term" in (k, j):
            if {k, j} & {"string", "date", "dateTime", "boolean"}:
                other = j if k == "term" else k
                want = XSD + other
                fix = lambda c, kk: F.when(T.datatype(c) == want, T.lex(c)).try_cast(_CASTS[other]) if kk == "term" else c
                x, y = fix(x, k), fix(y, j)
        elif k == j == "term" and sign not in ("=", "!="):
            nx, ny = T.number(x), T.number(y)
            both = nx.isNotNull() & ny.isNotNull()
            order = lambda p, q: {"<": p < q, "<=": p <= q, ">": p > q, ">=": p >= q}[sign]
            return F.when(both, order(nx, ny)).otherwise(F.when(T.datatype(x) == T.datatype(y), order(T.lex(x), T.lex(y))))
        elif k == j == "term":
            nx, ny = T.number(x), T.number(y)
            same = F.when(nx.isNotNull() & ny.isNotNull(), nx == ny).otherwise(x == y)
            return same if sign == "=" else ~same
        elif k != j and {k, j} == {"date", "dateTime"}:
            x, y = x.cast("timestamp_ntz"), y.cast("timestamp_ntz")
        elif k != j:
            return F.lit(sign == "!=") if sign in ("=", "!=") else F.lit(None).cast("boolean")
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign]

    def expr(self, e, scope) -> tuple[Column, str]:
        head = e[0]
        if head == "var":
            return scope.get(e[1], (F.lit(None).cast("string"), "term"))
        if head == "term":
            return self.constant(e[1])
        if head in ("||", "&&"):
            a, b = self.truth(self.expr(e[1], scope)), self.truth(self.expr(e[2], scope))
            return (a | b if head == "||" else a & b), "boolean"
        if head == "!":
            return ~self.truth(self.expr(e[1], scope)), "boolean"
        if head in ("=", "!=", "<", "<=", ">", ">="):
            return self.compare(head, self.expr(e[1], scope), self.expr(e[2], scope)), "boolean"
        if head == "in":
            x = self.expr(e[1], scope)
            return reduce(lambda p, q: p | q, [self.compare("=", x, self.expr(y, scope)) for y in e[2]], F.lit(False)), "boolean"
        if head == "neg":
            c, kind = self.num(self.expr(e[1], scope))
            return -c, kind
        if head in ("+", "-", "*", "/"):
            (x, k), (y, j) = self.num(self.expr(e[1], scope)), self.num(self.expr(e[2], scope))
            kind = NUMERIC[max(NUMERIC.index(k), NUMERIC.index(j))]
            if head == "/":
                kind = "decimal" if kind == "integer" else kind
                return F.try_divide(x.cast(_CASTS[kind]), y.cast(_CASTS[kind])).cast(_CASTS[kind]), kind
            x, y = x.cast(_CASTS[kind]), y.cast(_CASTS[kind])
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[head](x, y), kind
        if head == "cast":
            c, kind = self.expr(e[2], scope)
            to = e[1].removeprefix(XSD)
            if to not in _CASTS:
                raise Unsupported(f"no cast to {e[1]}")
            if kind in NUMERIC or kind == to:
                return (c.try_cast("double").cast("bigint") if to == "integer" else c.try_cast(_CASTS[to])), to
            return self.string(c, kind).try_cast(_CASTS[to]), to
        if head == "call":
            from ..functions.scalar import call

            return call(self, e[1], e[2], scope)
        if head == "exists":
            raise Unsupported("EXISTS stands in filters and BIND only")
        raise Unsupported(f"unknown expression {head!r}")

    # forms
    def out(self, r: Rel, name: str) -> Column:
        """A variable's value as a result column: IRIs as their text, literals natively."""
        kind = r.vars[name].kind
        if kind == "term" or kind.startswith("entity:"):
            return self.string(r.col(name), kind)
        return r.col(name)

    def run(self, q: Query) -> DataFrame:
        r = self.plan(q.op)
        if q.form == "SELECT":
            return r.df.select(*(self.out(r, n).alias(n) for n in r.vars if not n.startswith(".")))
        if q.form == "ASK":
            return r.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
        if q.form == "CONSTRUCT":
            def cell(t):
                if isinstance(t, Var):
                    return self.data.text(r.col(t.name), r.vars[t.name].kind) if t.name in r.vars else F.lit(None).cast("string")
                return F.lit(const_text(t))

            rows = [F.struct(cell(t.s).alias("s"), cell(t.p).alias("p"), cell(t.o).alias("o")) for t in q.template]
            out = r.df.select(F.explode(F.array(*rows)).alias("t")).select("t.*").dropna()
            # subjects are no literals and predicates are IRIs
            return out.where(~T.is_literal(F.col("s")) & T.is_iri(F.col("p"))).distinct()
        if self.data.quads is None and not self.data.catalog and "*" not in q.template and all(isinstance(t, Var) and t.name in r.vars and r.vars[t.name].kind.startswith("entity:") for t in q.template):
            # things of known classes have triples in their own tables alone
            parts = []
            for kind in {r.vars[t.name].kind: 0 for t in q.template}:
                names = [t.name for t in q.template if r.vars[t.name].kind == kind]
                keys = reduce(DataFrame.union, [r.df.select(r.col(n).alias("_k")) for n in names]).distinct()
                table = self.data.tables[kind[7:]]
                rows = table.df.join(keys, table.subject() == F.col("_k"), "left_semi")
                own = {p: c for p, c in self.data.predicates.items() if c[0] == kind[7:]}
                one = Dataset(self.spark, {kind[7:]: Table(rows, table.key, table.links)}, base=self.data.base)
                one.predicates = own
                parts.append(one.triples().select("s", "p", "o"))
            return reduce(DataFrame.union, parts)
        wanted = [t for t in q.template if t != "*"] if "*" not in q.template else [Var(n) for n in q.variables]
        parts = []
        for t in wanted:
            if isinstance(t, Var):
                parts.append(r.df.select(self.data.text(r.col(t.name), r.vars[t.name].kind).alias("s")))
            else:
                parts.append(self.spark.range(1).select(F.lit(const_text(t)).alias("s")))
        subjects = reduce(DataFrame.union, parts).distinct()
        return self.data.scan().join(subjects, "s", "left_semi").select("s", "p", "o")

