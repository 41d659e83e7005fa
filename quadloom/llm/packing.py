"""Packing documents into sequences: first-fit decreasing over a tournament tree.

Documents are tokenised, ended by ``end_id`` and cut at multiples of the
sequence length. The pieces are dealt to randomised groups of about
``group_docs`` documents, and each group is packed by itself: pieces by
falling length, each into the first sequence with room, which a tournament
tree of free capacities finds in logarithmic time.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed once each, and dealt to groups by their content, their task and how often
the task has met them, so no id fills one group; ties in length go by doc_id, then
start, then content; doc_ids are cast to long; further columns are ignored; no
documents give no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .tokens import encode_all

LENGTH = 4096
#: A group has about this many documents, and about this many characters at most.
GROUP_DOCS, GROUP_CHARS = 2000, 8_000_000
SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit(sizes: list[int], length: int) -> list[int]:
    """The bin of each size, in the order given: the first bin with room.

    ``best`` is a complete binary tree whose leaves are the bins' free
    capacities and whose inner nodes hold the larger of their children.
    """
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    best = [length] * (2 * leaves)
    out = []
    for size in sizes:
        k = 1
        while k < leaves:
            k += k
            if best[k] < size:
                k += 1
        out.append(k - leaves)
        best[k] -= size
        while k > 1:
            k >>= 1
            a, b = best[2 * k], best[2 * k + 1]
            top = a if a >= b else b
            if best[k] == top:
                break
            best[k] = top
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(tokenizer: str, end_id: int, length: int, groups: int, with_ids: bool):
    """Rows (grp, doc_id, start, length, ids, ids_crc32, doc_tokens): ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        from pyspark import TaskContext

        task = np.uint64(TaskContext.get().partitionId())
        again: dict[int, int] = {}  # how often the task has met a row, which deals repeated rows and null ids to many groups
        for batch in batches:
            for at, each in encode_all(tokenizer, batch.column(1)):
                doc = batch.column(0).slice(at, len(each))
                n = np.fromiter(map(len, each), np.int64, len(each)) + 1
                total = np.cumsum(n)
                ids = np.empty(int(total[-1]), "<u4")
                ids[total - 1] = end_id
                inner = np.ones(len(ids), bool)
                inner[total - 1] = False
                ids[inner] = np.concatenate(each)
                pieces = -(-n // length)
                of = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
                size = np.minimum(length, n[of] - start)
                bounds = np.concatenate(([0], np.cumsum(size))).astype(np.int32) * 4
                data = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids)])
                seed = pc.fill_null(doc, -1).to_numpy().astype(np.int64).view(np.uint64)
                whole = np.array([zlib.crc32(ids[b - k : b]) for b, k in zip(total.tolist(), n.tolist())], np.uint64)
                seed = _mix(_mix(seed + np.uint64(0x9E3779B97F4A7C15)) + whole)
                met = np.zeros(len(seed), np.uint64)
                for i, s in enumerate(seed.tolist()):
                    met[i] = again[s] = again.get(s, -1) + 1
                seed = _mix(seed + (met << np.uint64(24)) + task)
                grp = _mix(seed[of] + start.astype(np.uint64)) % np.uint64(groups)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((bounds[:-1] // 4).tolist(), (bounds[1:] // 4).tolist())]
                if not with_ids:
                    data = pa.nulls(len(of), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(grp.astype(np.int64)), doc.take(pa.array(of)), pa.array(start), pa.array(size), data, pa.array(crc, pa.int64()), pa.array(n[of])], ["grp", "doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"])

    return run


def _pack(length: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]))
        size = rows.column("length").to_numpy()
        bins = np.array(first_fit(size.tolist(), length), np.int64)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(size[order])
        first = np.concatenate(([True], np.diff(bins[order]) != 0))
        base = np.maximum.accumulate(np.where(first, ends - size[order], 0))
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - size[order] - base
        sequence = (rows.column("grp").to_numpy() << 24) + bins
        names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"]
        return pa.Table.from_arrays([*(rows.column(x) for x in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, group_docs: int = GROUP_DOCS, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece of each document.

    Packing looks at lengths alone, so without ``with_ids`` the ids stay where they were made and ``ids`` is null.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    groups = max(1, math.ceil(n / group_docs), math.ceil(chars / GROUP_CHARS))
    pieces = docs.mapInArrow(_pieces(tokenizer, end_id, length, groups, with_ids), "grp long, doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long")
    return pieces.groupBy("grp").applyInArrow(_pack(length), SCHEMA)
