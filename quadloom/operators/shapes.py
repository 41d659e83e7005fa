"""Constraints on facts, read from a vocabulary, and the rows that break them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraint:
    """On a property of a class: required, allowed values, a datatype with bounds, or a least number of values that match."""

    prop: str
    required: bool = False
    values: tuple = ()
    datatype: str | None = None
    low: float | None = None
    high: float | None = None
    matches: str | None = None
    min_count: int = 0
    exact: bool = False

    def hint(self) -> str:
        parts = ["required" if self.required else "optional"]
        if self.values:
            parts.append(", ".join(map(str, self.values)))
        if self.datatype:
            parts.append(self.datatype + (f" {self.low:g}-{self.high:g}" if self.low is not None and self.high is not None else ""))
        return " ".join(parts)


_TYPES = {"integer": "bigint", "decimal": "decimal(38,10)", "double": "double", "boolean": "boolean", "date": "date", "dateTime": "timestamp"}


def validate_table(df: DataFrame, key: str, constraints: list[Constraint]) -> DataFrame:
    """(key, prop, rule) of each broken rule; a wide table is judged in one scan."""
    found = []
    for c in constraints:
        v = F.col(c.prop)

        def add(cond, rule, c=c):
            found.append(F.when(cond, F.struct(F.lit(c.prop).alias("prop"), F.lit(rule).alias("rule"))))

        if c.required:
            add(v.isNull() | (F.trim(v.cast("string")) == ""), "required")
        if c.values:
            add(v.isNotNull() & ~v.isin(*c.values), "in")
        if c.datatype and c.datatype != "string":
            add(v.isNotNull() & v.cast("string").try_cast(_TYPES[c.datatype]).isNull(), "datatype")
        number = v.cast("string").try_cast("double")
        if c.low is not None:
            add(number < c.low, "low")
        if c.high is not None:
            add(number > c.high, "high")
        if c.matches and not c.min_count:
            add(v.isNotNull() & ~v.cast("string").rlike(c.matches), "pattern")
    return df.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*found))).alias("v")).select("key", "v.prop", "v.rule")


def validate_facts(instances: DataFrame, facts: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """The same over facts (key, prop, value), for instances (key): an instance without facts is judged as well."""
    tests = {c.prop: c for c in constraints}
    own = facts.where(F.col("prop").isin(*tests))
    checks = []
    for c in constraints:
        this, v = F.col("prop") == c.prop, F.col("value")
        good = F.lit(True)
        if c.values:
            good = good & v.isin(*[str(x) for x in c.values])
        if c.datatype and c.datatype != "string":
            good = good & v.try_cast(_TYPES[c.datatype]).isNotNull()
        if c.low is not None:
            good = good & (v.try_cast("double") >= c.low)
        if c.high is not None:
            good = good & (v.try_cast("double") <= c.high)
        counted = F.count(F.when(this & (v.rlike(c.matches) if c.matches else F.lit(True)), 1))
        checks += [F.coalesce(F.sum(F.when(this & ~F.coalesce(good, F.lit(False)), 1)), F.lit(0)).alias(f"bad_{len(checks)}"), counted.alias(f"n_{len(checks)}")]
    sums = instances.select("key").distinct().join(own, "key", "left").groupBy("key").agg(*checks)
    out = []
    for i, c in enumerate(constraints):
        bad, n = F.col(f"bad_{2 * i}"), F.col(f"n_{2 * i}")
        least = max(c.min_count, int(c.required))
        for cond, rule in ((bad > 0, "value"), (n != c.min_count if c.exact else n < least, "count")):
            out.append(F.when(cond, F.struct(F.lit(c.prop).alias("prop"), F.lit(rule).alias("rule"))))
    return sums.select("key", F.explode(F.array_compact(F.array(*out))).alias("v")).select("key", "v.prop", "v.rule")


def inherit(own: DataFrame, ancestors: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """Constraints (class, prop, ...) of each class with those of its ancestors (class, ancestor, depth); the nearest wins.

    ``same`` (prop, set) names properties that are equivalent; one of each set is left, the nearest, then the least by name.
    """
    reach = ancestors.select("class", "ancestor", "depth").union(own.select("class", F.col("class"), F.lit(0)).distinct())
    joined = reach.join(own.withColumnRenamed("class", "ancestor"), "ancestor")
    joined = joined.withColumn("_set", F.lit(None).cast("string")) if same is None else joined.join(same.select("prop", F.col("set").alias("_set")).dropDuplicates(["prop"]), "prop", "left")
    w = Window.partitionBy("class", F.coalesce("_set", "prop")).orderBy("depth", "prop", "ancestor")
    return joined.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_set", "ancestor", "depth")

