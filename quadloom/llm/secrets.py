"""Secret scan with corpus-wide ownership frequency, in DataFrame functions alone.

Three base kinds are matched in every text (leftmost, not overlapping, per
kind): assignments, access keys and hex runs. The value of every base span, and
every bare token of ``TOKEN`` that mixes letters and digits, is a candidate.
Candidate hashes are counted over the corpus by distinct repositories and
distinct owners. A value held by more than ``max_owners`` owners, or in more than
``max_repositories`` repositories of few owners, is a widely copied example; one
held by fewer looks live. (``documents`` has no repository column, so the query
takes each document as a repository and its source as the owner.) Bare tokens that look live become
spans of a fourth kind, ``owned``; base spans stay whatever their frequency and
are only told apart in ``n_live`` and ``n_example``.

Positions come from built-in functions: splitting a text at a pattern and
extracting the same pattern give gaps and matches in turn, whose lengths add up.

Defined cases: a null text counts as empty and has no span; rows repeated under
one doc_id are scanned each; a null owner is one owner of its own; columns other
than the named ones are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, stage

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# maximal runs, so the least length can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: A value of more owners, or of more repositories whoever owns them, is an example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 50
#: Matches whose lengths are added up together.
PART = 256


def _spans(text: Column, pattern: str, kind: str, value_group: int, least: int) -> Column:
    """array<struct<start, rank, finish, kind, value>> of the pattern's matches whose value has the least length.

    Lengths are added up in parts of ``PART`` matches, then over the parts, so the
    work grows with the matches and not with their square.
    """
    span = "array<struct<start:int,rank:int,finish:int,kind:string,value:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    gaps = F.split(text, pattern, -1)
    hits = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"), values.alias("value"))
    zero, empty = F.lit(0).cast("int"), F.array().cast(span)

    def one(at, p):
        start = at + F.length(p["gap"])
        return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.length(p["hit"])).cast("int").alias("finish"), F.lit(kind).alias("kind"), p["value"].alias("value"))

    def walked(part):
        return F.aggregate(
            part,
            F.struct(zero.alias("size"), empty.alias("out")),
            lambda acc, p: F.struct((acc["size"] + F.length(p["gap"]) + F.length(p["hit"])).cast("int").alias("size"), F.concat(acc["out"], F.array(one(acc["size"], p))).cast(span).alias("out")),
        )

    # the parts, each with spans relative to its own beginning; then each part's place
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(hits), F.lit(1)), F.lit(PART)), lambda i: walked(F.slice(hits, i, F.lit(PART))))
    def moved(part, at):
        return F.transform(part["out"], lambda s: F.struct((s["start"] + at).alias("start"), s["rank"].alias("rank"), (s["finish"] + at).alias("finish"), s["kind"].alias("kind"), s["value"].alias("value")))

    # an array of one (the parts) is walked over, so that the parts are made once
    whole = F.flatten(F.flatten(F.transform(F.array(parts), lambda ps: F.zip_with(ps, _placed(ps), moved))))
    return F.when(text.rlike(pattern), F.filter(whole, lambda s: F.length(s["value"]) >= least)).otherwise(empty)


def _placed(parts: Column) -> Column:
    """Where each part begins."""
    return F.aggregate(
        parts,
        F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, p: F.struct((acc["at"] + p["size"]).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["finish"])), ",")


def _example(span: Column, max_owners: int, max_repositories: int) -> Column:
    return (span["owners"] > max_owners) | (span["repositories"] > max_repositories)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(doc_id, base, added, all): arrays of spans struct(start, rank, finish, kind, value, owners, repositories)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(repository_col).cast("string").alias("repository"), F.col(owner_col).cast("string").alias("owner"), text.alias("text"))
    base = F.concat(_spans(F.col("text"), ASSIGN, "assign", 2, 6), _spans(F.col("text"), ACCESS, "access", 0, 20), _spans(F.col("text"), HEX, "hex", 0, 24))
    bare = F.filter(_spans(F.col("text"), TOKEN, "owned", 0, 20), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    rows = stage(rows.select("row", "doc_id", "repository", "owner", F.concat(base, bare).alias("spans")), "secrets")

    with Scratch(docs.sparkSession) as scratch:
        held = rows.where(F.size("spans") > 0).select("row", "repository", "owner", F.explode("spans").alias("span"))
        # a bare token that a base span overlaps is no candidate: the spans of a row are walked in order
        in_order = Window.partitionBy("row").orderBy("span.start", "span.rank")
        of_base = F.col("span.rank") < 3
        reached = F.max(F.when(of_base, F.col("span.finish"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
        # the next base span's start: base spans stand in order, so the first of those that follow
        next_start = F.first(F.when(of_base, F.col("span.start")), ignorenulls=True).over(in_order.rowsBetween(1, Window.unboundedFollowing))
        held = held.withColumns({"reached": reached, "next_start": next_start})
        free = of_base | ((F.coalesce("reached", F.lit(0)) <= F.col("span.start")) & (F.coalesce("next_start", F.col("span.finish")) >= F.col("span.finish")))
        held = scratch.stage(held.where(free).select("row", "repository", "owner", "span", F.sha2("span.value", 256).alias("hash")), "candidates")
        of_owner = held.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
        # written, so that both sides of the join are plain and the rows of one value can be split
        counts = scratch.stage(of_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")), "ownership")
        told = held.join(counts, "hash").select("row", F.struct("span.start", "span.rank", "span.finish", "span.kind", "span.value", "owners", "repositories").alias("span"))
        per_row = scratch.keep(told.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("found")), "spans")
    none = F.array().cast(per_row.schema["found"].dataType)
    out = rows.select("row", "doc_id").join(per_row, "row", "left").withColumn("found", F.coalesce("found", none))
    live = F.filter("found", lambda s: (s["rank"] == 3) & ~_example(s, max_owners, max_repositories))
    out = out.select("doc_id", F.filter("found", lambda s: s["rank"] < 3).alias("base"), live.alias("added"))
    return out.withColumn("all", F.array_sort(F.concat("base", "added")))


def digest(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """The query's columns from the spans of ``scan``."""

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    wide = F.size(F.filter("base", lambda s: _example(s, max_owners, max_repositories))).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
        (F.size("base") - wide).cast("long").alias("n_live"),
        wide.alias("n_example"),
    )


def oracle(docs: str = "documents", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> str:
    """The same in DuckDB's SQL."""

    def spans(pattern, kind, group, least):
        q = pattern.replace("'", "''")
        return f"""list_filter(list_transform(regexp_extract_all(t, '{q}', 0), lambda hit, i: struct_pack(
            start := CAST(coalesce(list_sum(list_transform(string_split_regex(t, '{q}')[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{q}', 0)[1:i-1], lambda g: length(g))), 0) AS BIGINT),
            rank := {KINDS.index(kind)},
            size := length(hit), kind := '{kind}', val := regexp_extract_all(t, '{q}', {group})[i])), lambda s: length(s.val) >= {least})"""

    name = "kind || ':' || start || ':' || (start + size)"
    return f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, doc_id AS repository, source AS owner, coalesce(text, '') AS t FROM {docs}),
found AS (SELECT r, repository, owner, unnest(list_concat(list_concat({spans(ASSIGN, "assign", 2, 6)}, {spans(ACCESS, "access", 0, 20)}), list_concat({spans(HEX, "hex", 0, 24)},
  list_filter({spans(TOKEN, "owned", 0, 20)}, lambda s: regexp_matches(s.val, '[0-9]') AND regexp_matches(s.val, '[A-Za-z]'))))) AS s FROM rows),
flat AS (SELECT r, repository, owner, s.start AS start, s.rank AS rank, s.size AS size, s.kind AS kind, s.val AS val FROM found),
free AS (SELECT * FROM flat f WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM flat b WHERE b.r = f.r AND b.rank < 3 AND b.start < f.start + f.size AND f.start < b.start + b.size)),
counts AS (SELECT val, count(DISTINCT coalesce(owner, chr(0))) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM free GROUP BY val),
told AS (SELECT free.*, owners > {max_owners} OR repositories > {max_repositories} AS example FROM free JOIN counts USING (val)),
per AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg({name}, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
  string_agg({name}, ',' ORDER BY start, rank) FILTER (rank < 3 OR NOT example) AS spans,
  count(*) FILTER (rank < 3 AND NOT example) AS n_live, count(*) FILTER (rank < 3 AND example) AS n_example FROM told GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM rows LEFT JOIN per USING (r)"""
