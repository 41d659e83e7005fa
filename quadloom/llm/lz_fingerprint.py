"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed left to right into dictionary phrases (LZ78): the longest
known phrase plus one symbol becomes a new phrase. Symbols are words; a word of
over ``CHUNK`` code points is several symbols, so texts without spaces parse as
well. The set of phrases is hashed and kept as ``SLOTS`` smallest hashes under
as many permutations, 16 bits each. The share of equal slots estimates how
large a part of their phrases two texts have in common, much as compressing
one text after the other would.

Defined cases: a null text counts as empty; an empty text, or one of white
space only, has the fingerprint of no phrases; equal texts have equal
fingerprints; rows that share a doc_id follow each other by falling hash of their
texts, then by falling text; a null doc_id comes last; doc_ids are cast to long;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

CHUNK, SLOTS = 12, 64
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)


def symbols(text: str) -> list[str]:
    words = text.split()
    if words and max(map(len, words)) > CHUNK:
        words = [w[i : i + CHUNK] for w in words for i in range(0, len(w), CHUNK)]
    return words


def phrases(text: str) -> np.ndarray:
    """Hashes of the text's LZ78 phrases, each once."""
    known: dict[tuple[int, str], int] = {}
    get, h64 = known.get, xxhash.xxh64_intdigest
    node = 0  # a phrase's hash is also its node: it seeds the hashes of its extensions
    for s in symbols(text):
        key = (node, s)
        if (node := get(key)) is None:
            known[key] = h64(s.encode("utf-8", "surrogatepass"), key[0])
            node = 0
    return np.unique(np.fromiter(known.values(), np.uint64, len(known)))


def signature(text: str) -> np.ndarray:
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    h = phrases(text)
    for at in range(0, len(h), 2048):
        x = h[at : at + 2048, None] * _A + _B
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    return (least >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(text: str | None) -> str:
    return signature(text or "").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the beginning of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches):
    """Rows (bucket, ahead, doc_id, text) in order; ``ahead`` marks the first document of the next bucket."""
    before = None  # (bucket, doc_id, text, signature) whose next document is not known yet
    last = None  # what was said of a text before the same text, for repeated rows

    for batch in batches:
        out = []
        for bucket, ahead, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            text = text or ""
            sign = None
            if before is not None and before[0] == bucket:
                b, d, t, s = before
                same = t == text
                sign = s if same else signature(text)
                if not same:
                    last = None
                if last is None:
                    e = edited(t, text)
                    es = signature(e)
                    said = (len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), s.tobytes().hex(), es.tobytes().hex(), likeness(s, es), likeness(s, sign))
                    last = said if same else None
                else:
                    said = last
                out.append((d, *said))
            else:
                last = None
            before = None if ahead else (bucket, doc, text, signature(text) if sign is None else sign)
        if out:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [x.split()[0] for x in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _range_index(x, cuts: list[int], lo: int, hi: int):
    """How many cuts are below ``x``, as a binary search."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x > cuts[mid], _range_index(x, cuts, mid + 1, hi)).otherwise(_range_index(x, cuts, lo, mid))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's, by falling doc_id; the last one's next is the first.

    Ids are cut into ranges, and an id (or the null ids) that fills a range by
    itself is cut by the hash of its texts; each range also gets the first row of
    the range that follows it, so every range is walked by itself and texts move
    once. The list of ranges is bounded by the number of shuffle partitions.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, nulls, rows = docs.agg(F.percentile_approx("doc_id", [i / (4 * n) for i in range(1, 4 * n)], 100_000), F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    often = Counter(cuts or [])
    # an id at several cuts has a range of its own
    ranges = sorted(set(often) | {c - 1 for c, k in often.items() if k > 1})
    index = _range_index(F.col("doc_id"), ranges, 0, len(ranges))
    shares = {ranges.index(c): k + 1 for c, k in often.items() if k > 1}
    if nulls:
        shares[-1] = 1 + 4 * n * nulls // rows
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(index).cast("int")
    # rows of one id stand by falling hash of their text; ranges are numbered so that they rise as documents fall
    hashed = F.xxhash64("text")
    parts = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in shares.items() for x in kv)), bucket), F.lit(1)) if shares else F.lit(1)
    part = F.least(((-hashed.cast("double") / 2.0**64 + 0.5) * parts).cast("int"), parts - 1)
    rows = docs.select("doc_id", "text", hashed.alias("hash"), ((F.lit(len(ranges) + 1) - bucket).cast("long") * (1 << 20) + part).alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), "hash", "text")).alias("head"))
    present = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
    before = spark.createDataFrame(list(zip(present, present[-1:] + present[:-1])), "bucket long, before long")
    heads = heads.join(F.broadcast(before), "bucket").select(F.col("before").alias("bucket"), F.lit(1).alias("ahead"), F.col("head.o").alias("doc_id"), "head.hash", "head.text")
    both = rows.select("bucket", F.lit(0).alias("ahead"), "doc_id", "hash", "text").union(heads)
    both = both.repartition(n, "bucket").sortWithinPartitions("bucket", "ahead", F.desc_nulls_last("doc_id"), F.desc("hash"), F.desc("text"))
    return both.select("bucket", "ahead", "doc_id", "text").mapInArrow(_walk, OUT)
