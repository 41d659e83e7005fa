"""Near duplicates by exact Jaccard similarity: SimHash and MinHash propose, the shingles themselves decide.

Two texts are linked when their sets of word shingles have a Jaccard similarity
of ``at_least``. 64 bits of SimHash cannot see that alone: at a similarity of
0.8 about ten bits differ, give or take three, and a radius that wide has no
bands to search by. So candidates come from two sides:

* each group that SimHash and its BK-trees join is a shard;
* the least shingle hashes under ``BANDS`` x ``ROWS`` permutations are cut into
  bands, and texts that agree in a whole band share a shard. A pair of similarity
  s is met with probability 1 - (1 - s^ROWS)^BANDS: 0.9997 at 0.8.

Within a shard no pair is taken on trust and none is left out: a text is
compared with a leader of each group seen so far. Since 1 - Jaccard is a
metric, a group whose leader is further than twice the allowed distance has no
member within it; of the other groups the members are compared one by one.
Texts of equal shingle sets are one node throughout. A shard of more than
``block`` nodes is cut into blocks, and each two blocks meet in one cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, free_name, holds, ship, sized, stage

BANDS, ROWS = 20, 5
_KEYS = np.random.default_rng(64).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
_PART = 1 << 13


def grams(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending; words as SimHash has them."""
    return np.unique(simhash.shingle_hashes(text, shingle))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def bands(own: np.ndarray) -> np.ndarray:
    """A hash for each band; texts without words have none."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), _PART):
        x = own[at : at + _PART, None] * _KEYS[0] + _KEYS[1]
        least = np.minimum(least, ((x ^ (x >> np.uint64(32))) * _KEYS[0]).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def _sketches(shingle: int):
    """Rows (row, text): (row, node, bands); ``node`` names the set of shingles."""

    def run(batches):
        holds("near")
        for batch in batches:
            own = [grams(t.as_py(), shingle) for t in batch.column(1)]
            node = np.array([xxhash.xxh64_intdigest(g.tobytes()) for g in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array([bands(g) for g in own], pa.list_(pa.int64()))], ["row", "node", "bands"])

    return run


class Groups:
    """What a cell has seen: groups of nodes, each with a leader and the members linked to it."""

    def __init__(self, at_least: float):
        self.least, self.reach, self.groups = at_least, 1 - 2 * (1 - at_least), []

    def add(self, node: int, own: np.ndarray) -> list[tuple[int, int]]:
        """Links of the node, one for each group that it is linked with."""
        out, home = [], None
        for group in self.groups:
            s = jaccard(own, group[0][1])
            if s >= self.least:
                out.append((node, group[0][0]))
                home = home or group
            elif s >= self.reach - 1e-9:
                near = next((n for n, g in group[1:] if jaccard(own, g) >= self.least), None)
                if near is not None:
                    out.append((node, near))
        if home is None:
            self.groups.append([(node, own)])
        else:
            home.append((node, own))
        return out


def _verified(shingle: int, at_least: float):
    """Rows (cell, node, text), sorted by cell: links (u, v)."""

    def run(batches):
        cell = groups = None
        for batch in batches:
            out = []
            for c, node, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if groups is None or c != cell:
                    cell, groups = c, Groups(at_least)
                out += groups.add(node, grams(text, shingle))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["u", "v"])

    return run


def groups(rows: DataFrame, shingle: int = 5, radius: int = 6, at_least: float = 0.8, id_col: str = "row", block: int = 4096) -> DataFrame:
    """(id, group) for every row of ``rows``, whose ids are distinct: rows joined by links of ``at_least`` share a group."""
    spark = rows.sparkSession
    ship(spark)
    texts = rows.select(F.col(id_col).alias("row"), "text")
    sketches = stage(texts.mapInArrow(_sketches(shingle), "row long, node long, bands array<long>"), "sketches")
    with Scratch(spark) as scratch:
        alike = simhash.near_duplicates(texts, shingle, radius, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
        nodes = sketches.groupBy("node").agg(F.min("row").alias("row"), F.first("bands").alias("bands"))
        nodes = scratch.stage(sized(nodes.join(alike, "row")), "near-nodes")
        names = F.concat("bands", F.array(F.xxhash64(F.lit("simhash"), "component_id")))
        routed = nodes.select(F.explode(names).alias("shard"), "node", "row")
        hot = routed.groupBy("shard").agg(F.count("*").alias("rows")).where("rows > 1")
        routed = routed.join(hot.hint("merge"), "shard")  # never a broadcast, as in simhash.links
        parts = F.ceil(F.col("rows") / block).cast("int")
        mine = F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")
        others = F.filter(F.sequence(F.lit(0), parts - 1), lambda j: (parts == 1) | (j != mine))
        cells = F.transform(others, lambda j: F.xxhash64(F.col("shard"), F.least(mine, j), F.greatest(mine, j)))
        cells = scratch.stage(sized(routed.select(F.explode(cells).alias("cell"), "node", "row")), "near-cells")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        filled = cells.join(texts.hint("merge"), "row").select("cell", "node", "text").repartition(n, "cell").sortWithinPartitions("cell")
        roots = simhash.components(filled.mapInArrow(_verified(shingle, at_least), "u long, v long"))
    group = free_name("root", [id_col, "row", "node"])
    return sketches.join(roots.withColumnRenamed("root", group), "node", "left").select(F.col("row").alias(id_col), F.coalesce(group, "node").alias("group"))
