"""Graphs as things with a description, and keeping them in step with what they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import diff_tables

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def describe_graphs(quads: DataFrame, base: str, owner: str, kinds: dict[str, str], visibility: str = "private") -> DataFrame:
    """(graph, class, owner, visibility, quads): a row for each graph; ``kinds`` maps endings of graph names to classes, all others are current."""
    cls = F.lit("CurrentGraph")
    for ending, kind in kinds.items():
        cls = F.when(F.col("g").endswith(f"{ending}>"), kind).otherwise(cls)
    counted = quads.where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("quads"))
    return counted.select(F.col("g").alias("graph"), cls.alias("class"), F.lit(owner).alias("owner"), F.lit(visibility).alias("visibility"), "quads")


def keep_graphs(quads: DataFrame, keep: DataFrame) -> DataFrame:
    """Quads of the graphs that ``keep`` (g) lists, and those of the unnamed graph: derived and foreign ones go."""
    return quads.where("g IS NULL").unionByName(quads.join(keep.select("g").distinct(), "g", "left_semi").select(quads.columns))


def may_skip(head: int | None, stored: DataFrame, graphs: DataFrame, graph: str, file_facts: DataFrame, clean: bool, rewound: DataFrame) -> bool:
    """Whether a sync has nothing to do: the head's ordinal is stored, its graph is there with facts of files, the
    extraction folder is clean, and no stored commit has left the history."""
    return bool(
        clean
        and head is not None
        and not stored.where(F.col("ordinal") == head).isEmpty()
        and not graphs.where(F.col("graph") == graph).isEmpty()
        and not file_facts.isEmpty()
        and rewound.isEmpty()
    )


def update(quads: DataFrame, remove: DataFrame, add: DataFrame) -> DataFrame:
    """Delete, then insert, as sets of quads (s, p, o, g); the graph may be null."""
    names = ["s", "p", "o", "g"]
    return quads.select(names).subtract(remove.select(names)).union(add.select(names)).distinct()


def reload(old: DataFrame, new: DataFrame) -> DataFrame:
    """(..., change): the rows that a diffed load of a graph writes and deletes; equal rows are not touched."""
    added, removed = diff_tables(old, new)
    return added.withColumn("change", F.lit("+")).unionByName(removed.withColumn("change", F.lit("-")))


def load_in_batches(quads: DataFrame, path: str, rows: int = 200_000) -> None:
    """Write files of at most ``rows`` quads each; Spark's committer makes the load appear as a whole or not at all."""
    quads.write.option("maxRecordsPerFile", rows).mode("overwrite").parquet(path)


def registry(entries: DataFrame, exists: DataFrame) -> DataFrame:
    """(path, last_used, name): known stores (path, last_used, name), one for each resolved path, the latest; those whose folder is gone (not in ``exists``) are left out."""
    resolved = entries.withColumn("path", F.regexp_replace("path", "/+$", ""))
    folded = resolved.groupBy("path").agg(F.max(F.struct("last_used", "name")).alias("x")).select("path", "x.last_used", "x.name")
    return folded.join(exists.select("path").distinct(), "path", "left_semi").orderBy(F.desc("last_used"))


def config_triples(settings: dict, subject: str, base: str, known: set[str]) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(triples, warnings) of a repository's settings: a scalar is one property, a list is repeated, an unknown key warns."""
    from ..sources.turtle import literal

    out, warnings = [], []
    for key, value in settings.items():
        if key not in known:
            warnings.append(f"unknown key {key!r}")
            continue
        for v in value if isinstance(value, list) else [value]:
            if v is None or isinstance(v, (dict, list)):
                continue
            text = str(v).lower() if isinstance(v, bool) else str(v)
            out.append((f"<{subject}>", f"<{base}repo/{key}>", literal(text)))
    return out, warnings


def upsert_manifest(stored: dict, own: dict, owned: set[str]) -> dict:
    """``stored`` with the keys that are owned taken from ``own``; foreign keys stay as they are."""
    return {k: v for k, v in stored.items() if k not in owned} | {k: v for k, v in own.items() if k in owned}


def equivalents(triples: DataFrame, same: DataFrame, keep_graphs_of: list[str] = ()) -> DataFrame:
    """Quads with predicates rewritten to the declared spelling (name, declared), except inside the graphs that are listed."""
    held = F.coalesce(F.col("g").isin(list(keep_graphs_of)), F.lit(False)) if keep_graphs_of else F.lit(False)
    joined = triples.join(F.broadcast(same.select(F.col("name").alias("p"), "declared")), "p", "left")
    return joined.select("s", F.when(~held & F.col("declared").isNotNull(), F.col("declared")).otherwise(F.col("p")).alias("p"), "o", "g")
