"""An append-only log of asserted and retracted statements, and what follows from it.

Events are rows (stmt columns..., op "+" or "-", ordinal). Everything that is
derived is one grouped pass: a statement is live when its last assertion is
later than its last retraction. No operator compares events with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_id(op, commit, s, p, o):
    """First 16 hex digits of the SHA-256 of an event's fields."""
    return F.substring(F.sha2(F.concat_ws("|", op, commit, s, p, o), 256), 1, 16)


def diff_events(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What a change asserts and retracts. ``keys`` hold the commit and the statement; what was only moved cancels."""
    old, new = old.select(keys).distinct(), new.select(keys).distinct()
    return new.join(old, keys, "left_anti").withColumn("op", F.lit("+")).unionByName(old.join(new, keys, "left_anti").withColumn("op", F.lit("-")))


def guard_retracts(events: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Drops retractions of statements that an untouched document still makes; assertions are not guarded."""
    kept = events.where("op = '-'").join(held.select(keys).distinct(), keys, "left_anti")
    return events.where("op = '+'").unionByName(kept)


def _last(op: str):
    return F.max(F.when(F.col("op") == op, F.col("ordinal")))


def marks(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, asserted, retracted): the last ordinals of either kind; merges by maximum, in any order."""
    return events.groupBy(keys).agg(_last("+").alias("asserted"), _last("-").alias("retracted"))


_LIVE = "asserted IS NOT NULL AND (retracted IS NULL OR retracted < asserted)"


def live(events: DataFrame, keys: list[str], at: int | None = None) -> DataFrame:
    """Statements that hold (at an ordinal). One asserted and retracted at the same ordinal does not."""
    if at is not None:
        events = events.where(F.col("ordinal") <= at)
    return marks(events, keys).where(_LIVE).select(keys)


def base_layer(events: DataFrame, keys: list[str]) -> DataFrame:
    """Last operation wins; within an ordinal a retraction precedes an assertion."""
    last = F.max_by("op", F.struct("ordinal", (F.col("op") == "+").cast("int")))
    return events.groupBy(keys).agg(last.alias("op")).where("op = '+'").select(keys)


def lifespans(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, born, died): each assertion with the earliest retraction at its ordinal or later; open ones have none."""
    w = Window.partitionBy(*keys).orderBy("ordinal").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    died = F.min(F.when(F.col("op") == "-", F.col("ordinal"))).over(w)
    spans = events.withColumn("died", died).where("op = '+'").groupBy(*keys, "ordinal").agg(F.min("died").alias("died"))
    return spans.withColumnRenamed("ordinal", "born")


def change_log(events: DataFrame, commits: DataFrame) -> DataFrame:
    """Events with their commit's fields, in order."""
    return events.join(commits, "ordinal").orderBy("ordinal")


def now_view(base: DataFrame, event_subjects: DataFrame) -> DataFrame:
    """Base facts without those that describe events."""
    return base.where(F.col("p") != "<http://www.w3.org/1999/02/22-rdf-syntax-ns#reifies>").join(event_subjects.select("s").distinct(), "s", "left_anti")


def refresh(now: DataFrame, base: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """``now`` with the rows of changed subjects taken from ``base``."""
    changed = changed.select(key).distinct()
    return now.join(changed, key, "left_anti").unionByName(base.join(changed, key, "left_semi"))


def diff_tables(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed) rows: what a diffed reload has to write."""
    return new.exceptAll(old), old.exceptAll(new)


def resume_point(seen: DataFrame, ancestors: DataFrame) -> DataFrame:
    """The newest stored commit that is still an ancestor; no row after a rewind of everything."""
    return seen.join(ancestors.select("commit"), "commit", "left_semi").agg(F.max_by("commit", "ordinal").alias("commit"), F.max("ordinal").alias("ordinal")).where("commit IS NOT NULL")


def rewound(seen: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Stored commits that are no ancestors any more: any row calls for a rebuild."""
    return seen.select("commit").distinct().join(ancestors.select("commit"), "commit", "left_anti")
