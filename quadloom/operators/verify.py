"""Checks over logs and facts. Each gives the offending rows; none means that all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import live


def integrity(events: DataFrame) -> DataFrame:
    """Events (event, stmt, asserted_in, retracted_in) with several statements, several commits of a kind, or both kinds: one grouped pass."""
    counted = events.groupBy("event").agg(F.count_distinct("stmt").alias("stmts"), F.count_distinct("asserted_in").alias("asserts"), F.count_distinct("retracted_in").alias("retracts"))
    return counted.where("stmts > 1 OR asserts > 1 OR retracts > 1 OR (asserts > 0 AND retracts > 0)")


def dangling(events: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits that events name and the commit table lacks."""
    return events.select("commit").where("commit IS NOT NULL").distinct().join(commits.select("commit"), "commit", "left_anti")


def parity(base: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Statements on which the stored state and the log differ, with the side that has them."""
    derived = live(events, keys)
    stored = base.select(keys).distinct()
    return stored.join(derived, keys, "left_anti").withColumn("only_in", F.lit("stored")).unionByName(derived.join(stored, keys, "left_anti").withColumn("only_in", F.lit("log")))


def scoped_parity(base: DataFrame, events: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """``parity`` for the changed statements alone."""
    changed = changed.select(keys).distinct()
    return parity(base.join(changed, keys, "left_semi"), events.join(changed, keys, "left_semi"), keys)


def duplicate_ids(claims: DataFrame, thing: str, file: str) -> DataFrame:
    """Things that several files claim."""
    return claims.groupBy(thing).agg(F.count_distinct(file).alias("files")).where("files > 1")


def unresolved(refs: DataFrame, targets: DataFrame, ref: str, key: str) -> DataFrame:
    """References to rows that do not exist."""
    return refs.where(F.col(ref).isNotNull()).join(targets.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


OPERATORS = ("hasValue", "linksTo")


def malformed_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines that are not ``subject | operator | object``."""
    f = F.split(column, r" \| ", 3)
    part = lambda i: F.try_element_at(f, F.lit(i))
    rules = [
        (F.trim(column) == "", "blank"),
        (F.size(f) < 3, "fields"),
        (~part(2).isin(*OPERATORS), "operator"),
        (F.trim(part(1)) == "", "subject"),
        (F.col(column).rlike(r"[\x00-\x08\x0b-\x1f\x7f]"), "control character"),
        ((part(2) == "linksTo") & (F.trim(part(3)) == ""), "empty link"),
    ]
    problem = reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))
    return lines.withColumn("problem", problem).where("problem IS NOT NULL")


def components(edges: DataFrame, closure) -> DataFrame:
    """(node, root) of undirected edges (a, b), e.g. equivalent properties; for tables of vocabulary size."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("s", "o").distinct()
    reach = closure(both)
    return reach.groupBy("s").agg(F.least(F.min("o"), F.first("s")).alias("root")).withColumnRenamed("s", "node")


def orphans(sidecars: DataFrame, sources: DataFrame, suffixes: list[str]) -> DataFrame:
    """Sidecars (path, source) of known suffixes whose source is gone."""
    known = reduce(lambda a, b: a | b, [F.col("path").endswith(x) for x in suffixes])
    return sidecars.where(known).join(sources.select(F.col("path").alias("source")), "source", "left_anti")


def readable(catalog: DataFrame, reader: str) -> DataFrame:
    """Graphs (g, owner, visibility, readers) that someone may read; an unknown visibility is private."""
    return catalog.where((F.col("owner") == reader) | (F.col("visibility") == "public") | (F.col("visibility") == "shared") & F.coalesce(F.array_contains("readers", reader), F.lit(False)))
