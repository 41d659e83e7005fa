"""SimHash near-duplicate groups, found with BK-trees.

A document's fingerprint has bit b set when over half of its shingle hashes
have it set. Two fingerprints are linked when at most ``radius`` bits differ.

How links are found without comparing all pairs:

* equal fingerprints collapse first, so a group of copies is one node;
* 64 bits are cut into ``radius + 2`` bands. Fingerprints within the radius
  agree in at least two whole bands, so each fingerprint is sent to one shard
  per pair of bands, keyed by those bits. No pair within the radius is lost;
* every shard holds a BK-tree: a child hangs on the edge numbered by its
  Hamming distance to the parent, and a search follows only the edges within
  ``radius`` of the query's own distance;
* a shard of more than ``block`` fingerprints is cut into blocks. Each block
  gets its own tree, and that tree goes to every block of the shard. Bands of
  uniform bits make such shards rare: two of six bands are over 20 bits;
* a task works through its shards in runs of about ``RUN`` fingerprints and keeps
  a spanning forest of the links it saw, not each link, which leaves
  reachability as it is. Hits are joined as they come, ``FRONT`` at a time.

Components come from alternating large-star and small-star passes.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; rows repeated under one doc_id
each give a row; a null doc_id is never a component's name unless nothing else
is in it; further columns are ignored; doc_ids are cast to long.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, holds, ship, sized, stage

_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"     abcdefghijklmnopqrstuvwxyz")
_SPARE = b" "
_HEAP = 1 << 16
#: Fingerprints that a task holds at once (and the rest of a shard), and pairs that a search looks at.
RUN, FRONT = 1 << 18, 1 << 21


def _shingles(text: str | None, shingle: int):
    """How many shingles a text has, and their hashes in parts."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_SPACE).split(_SPARE)
    words = [w for w in words if w]
    if not words:
        return 0, iter(())
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    k = min(shingle, len(words))
    n = len(words) - k + 1
    a, b = starts[:n].tolist(), (ends[k - 1 :] - 1).tolist()
    h64 = xxhash.xxh64_intdigest
    return n, (np.fromiter((h64(joined[x:y], 42) for x, y in zip(a[at : at + _HEAP], b[at : at + _HEAP])), np.uint64, min(_HEAP, n - at)) for at in range(0, n, _HEAP))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes that a fingerprint is made of, in the order of the text."""
    return np.concatenate([np.zeros(0, np.uint64), *_shingles(text, shingle)[1]])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of one text."""
    n, parts = _shingles(text, shingle)
    total = np.zeros(64, np.int64)
    for h in parts:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * total > n).tolist())


def _fingerprints(shingle: int):
    def run(batches):
        holds("simhash")
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """BK-trees over ``codes``, one for each value of ``shard``; codes are distinct within a shard."""

    def __init__(self, codes: np.ndarray, shard: np.ndarray):
        self.codes = codes
        order = np.argsort(shard, kind="stable")
        self.shards, first = np.unique(shard[order], return_index=True)
        self.roots = order[first]
        self.largest = int(np.diff(np.append(first, len(order))).max()) if len(first) else 0
        left = np.ones(len(codes), bool)
        left[self.roots] = False
        rest = order[left[order]]
        parent = self.roots[np.searchsorted(self.shards, shard[rest])]
        edges, kids = [], []
        while len(rest):
            key = parent * 65 + bits_between(codes[rest], codes[parent])
            sort = np.argsort(key, kind="stable")
            rest, key = rest[sort], key[sort]
            edge, at, back = np.unique(key, return_index=True, return_inverse=True)
            edges.append(edge)
            kids.append(rest[at])
            below = np.ones(len(rest), bool)
            below[at] = False
            parent = rest[at][back][below]
            rest = rest[below]
        edge, kid = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges, kids))
        sort = np.argsort(edge, kind="stable")
        self.edge, self.kid = edge[sort], kid[sort]

    def search(self, queries: np.ndarray, shard: np.ndarray, radius: int):
        """Yields (query index, node index) arrays of all codes within the radius in the query's own shard."""
        at = np.searchsorted(self.shards, shard)
        at[at == len(self.shards)] = 0
        known = np.flatnonzero(self.shards[at] == shard) if len(self.shards) else np.zeros(0, np.int64)
        # a search never stands at more nodes than its shard has, so FRONT bounds what it holds
        part = max(64, FRONT // max(1, self.largest))
        for lo in range(0, len(known), part):
            q = known[lo : lo + part]
            node = self.roots[at[q]]
            while len(q):
                d = bits_between(queries[q], self.codes[node])
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                a = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0), "left")
                b = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right")
                n = b - a
                q = np.repeat(q, n)
                skip = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n)
                node = self.kid[np.arange(len(q)) + skip]


class Joined:
    """Which of n things hang together, and the links that first joined them."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def flat(self) -> np.ndarray:
        while (self.up != (up := self.up[self.up])).any():
            self.up = up
        return self.up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.flat()
        new = up[a] != up[b]
        _, first = np.unique(np.stack([up[a][new], up[b][new]]), axis=1, return_index=True)
        for x, y in zip(a[new][first].tolist(), b[new][first].tolist()):
            rx, ry = self.top(x), self.top(y)
            if rx != ry:
                self.up[max(rx, ry)] = min(rx, ry)
                self.links.append((x, y))

    def top(self, x: int) -> int:
        while (y := int(self.up[x])) != x:
            self.up[x] = self.up[y]
            x = y
        return x


def _links(radius: int):
    """Rows (shard, side, fp), sorted by shard: side 1 builds the trees, side 0 asks; a plain shard's rows are both (side 2)."""

    def search(shard, side, fp):
        tree, ask = np.flatnonzero(side > 0), np.flatnonzero(side != 1)
        forest = Forest(fp[tree], shard[tree])
        codes, of = np.unique(fp, return_inverse=True)
        joined = Joined(len(codes))
        for q, n in forest.search(fp[ask], shard[ask], radius):
            joined.add(of[ask[q]], of[tree[n]])
        codes = codes.view(np.int64)
        ends = np.array(joined.links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(codes[ends[:, 0]]), pa.array(codes[ends[:, 1]])], ["u", "v"])

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)]
        for x in batches:
            new = x.column(0).to_numpy(), x.column(1).to_numpy(), x.column(2).to_numpy().view(np.uint64)
            held = [np.concatenate(p) for p in zip(held, new)]
            if len(held[0]) >= RUN:
                whole = int(np.searchsorted(held[0], held[0][-1]))  # the last shard may go on
                if whole:
                    yield search(*(c[:whole] for c in held))
                    held = [c[whole:] for c in held]
        if len(held[0]):
            yield search(*held)

    return run


def band_keys(radius: int, alike: int = 2):
    """Columns naming the shards of ``fp``: one for each choice of ``alike`` bands."""
    n = radius + alike
    cuts = [64 * i // n for i in range(n + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(n), alike)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask).cast("long"))))
    return keys


def links(prints: DataFrame, radius: int = 4, block: int = 4096) -> DataFrame:
    """(u, v): links between distinct values of ``fp`` that join all which lie within the radius.

    Shard names are 64-bit hashes of the bands; two shards under one name would
    only be searched together, which adds no wrong link.
    """
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = prints.select(F.explode(F.array(*band_keys(radius))).alias("shard"), "fp")
    hot = routed.groupBy("shard").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    routed = routed.join(hot.hint("merge"), "shard")  # Spark takes what explode makes for as small as its input and may broadcast it
    parts = F.ceil(F.col("rows") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), parts).cast("int")
    # block i's tree answers blocks i, i + 1, ...: the tree's rows go to each of those cells
    cells = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda j: F.struct(
            F.when(parts == 1, F.col("shard")).otherwise(F.xxhash64(F.col("shard"), F.least(mine, j), F.greatest(mine, j))).alias("shard"),
            F.when(j == mine, 2).when(mine < j, 1).otherwise(0).cast("int").alias("side"),
            F.col("fp"),
        ),
    )
    cells = routed.select(F.explode(cells).alias("c")).select("c.shard", "c.side", "c.fp")
    found = cells.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_links(radius), "u long, v long")
    return found.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the links (u, v).

    Large-star and small-star passes settle in O(log^2) rounds of the longest path,
    so 60 are beyond any input; a table of each pass is deleted once the next is there.
    The tables are as many files as their rows call for, for a pass writes four of them.
    """
    with Scratch(edges.sparkSession) as scratch:
        edges = scratch.stage(sized(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), "edges")

        def sums(e):
            return tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

        state = sums(edges)
        for _ in range(max_rounds):
            if not state[0]:
                break
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            # the least neighbours are written, so both sides of a join are plain and a hub's rows can be split
            least = scratch.stage(sized(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 1), "least")
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            large = scratch.stage(sized(large, 1), "large-star")
            scratch.drop_all_but(1)
            least = scratch.stage(sized(large.groupBy("u").agg(F.min("v").alias("m")), 1), "least")
            small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            edges = scratch.stage(sized(small.select("e.u", "e.v").where("u <> v").distinct(), 1), "small-star")
            scratch.drop_all_but(1)
            now = sums(edges)
            if now == state:
                break
            state = now
        else:
            raise RuntimeError("components did not settle")
        found = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        return scratch.keep(sized(found, 1), "components")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for every row of ``docs``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stage(rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "fingerprints")
    with Scratch(docs.sparkSession) as scratch:
        nodes = scratch.stage(sized(rows.groupBy("fp").agg(F.min("doc_id").alias("least"))), "fingerprint-nodes")
        roots = components(links(nodes.select("fp"), radius, block))
        roots = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        roots = scratch.keep(sized(roots), "roots")
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(named, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
