"""Benchmark decontamination: BM25 over test items, searched by block-max WAND.

The test items are the index and the training passages are the queries. An
item's question (its first half) and its answer (the second) are entries of their
own, for a document may hold them far apart. Entries lie in tiers by length (up to 16, 32, 64, ... words). For a tier of items of up
to H words a passage is a window of 5H/4 words every H/4 words, so any run of H
words lies within one passage and a passage is not much longer than what it is
compared with. A term's impact on an item is its BM25 weight as a share of the
item's score for its own text, so one threshold fits items of any length.

* a tier's items are dealt to at most ``SUPER`` superblocks. A passage whose
  terms' largest impacts in a superblock do not add up to the threshold has no
  pivot there, and WAND leaves it; this bound is computed for all passages of a
  batch at once, from running sums;
* items are in blocks of ``BLOCK`` and every posting list keeps its largest
  impact in each block. For a passage that is left, these block maxima are added
  up; blocks that stay below the threshold are skipped whole, and items are
  scored in the others only. All items at or above the threshold are retrieved,
  not the best k, so the threshold never rises and blocks can be judged at once
  instead of pivot by pivot.

Every retrieved pair is verified on the whole document: an item counts as found
when of its question (its first half) and of its answer (the second) at least
``OVERLAP`` of the 5-word shingles occur in the document (shorter halves: the
words in a row).

A benchmark of more than ``PART_ITEMS`` items or ``PART_CHARS`` characters is dealt
to parts in Spark, with its word statistics counted there. Parts are searched one
after the other: one is read, indexed, broadcast and destroyed before the next, so
what the driver and a broadcast hold is bounded by a part.

Defined cases: null texts count as empty; an item without words is never found;
repeated items or documents are found each; a null item_id or doc_id is kept as
it is; ids are cast to long; further columns are ignored (kept, where documents are
filtered); an empty table on either side finds nothing.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, holds, ship, stage

BLOCK, SUPER = 8, 12
THRESHOLD, OVERLAP, SHINGLE = 0.7, 0.8, 5
PART_ITEMS, PART_CHARS = 20_000, 16_000_000
K1, B = 1.2, 0.75
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’¿¡…–—"
#: Documents of about this many characters are searched together.
STEP = 2_000_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs without white space and punctuation."""
    text = (text or "").lower()
    for c in _PUNCT:
        if c in text:
            text = text.replace(c, " ")
    return text.split()


def _ranges(bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The positions bounds[r] to bounds[r + 1] of every row, end to end."""
    a = bounds[rows]
    n = bounds[rows + 1] - a
    ends = np.cumsum(n)
    return np.arange(ends[-1]) + np.repeat(a - ends + n, n)


class Tier:
    """Inverted index of the items of up to ``most`` words; term 0 stands for all words that no item has."""

    def __init__(self, words: list[list[str]], most: int, term: dict[str, int], n_items: int, df: dict[str, int], mean_words: float, threshold: float):
        self.threshold = threshold
        self.passage, self.stride = most + most // 4, most // 4
        self.words = words
        lists: list[list[tuple[int, float]]] = [[] for _ in range(len(term) + 1)]
        for k, ws in enumerate(self.words):
            weights = {}
            for t, n in Counter(ws).items():
                idf = np.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5))
                weights[t] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(ws) / mean_words))
            own = sum(weights.values())
            for t, w in weights.items():
                lists[term[t]].append((k, w / own))
        self.wide = max(BLOCK, -(-len(words) // SUPER))
        self.top = np.zeros((-(-len(words) // self.wide), len(lists)))
        for t, x in enumerate(lists):
            for k, w in x:
                self.top[k // self.wide, t] = max(w, self.top[k // self.wide, t])
        self.at = np.cumsum([0, *map(len, lists)])
        self.item = np.array([k for x in lists for k, _ in x], np.int64)
        self.impact = np.array([w for x in lists for _, w in x])
        blocks: list[dict[int, float]] = []
        for x in lists:
            tops: dict[int, float] = {}
            for k, w in x:
                tops[k // BLOCK] = max(w, tops.get(k // BLOCK, 0.0))
            blocks.append(tops)
        self.block_at = np.cumsum([0, *map(len, blocks)])
        self.block = np.array([b for x in blocks for b in x], np.int64)
        self.block_top = np.array([w for x in blocks for w in x.values()])

    def retrieve(self, terms: np.ndarray) -> list[int]:
        """Items whose summed impacts reach the threshold."""
        need = self.threshold - 1e-9
        at = _ranges(self.block_at, terms)
        good = np.bincount(self.block[at], self.block_top[at]) >= need
        if not good.any():
            return []
        at = _ranges(self.at, terms)
        at = at[good[self.item[at] // BLOCK]]
        return np.flatnonzero(np.bincount(self.item[at], self.impact[at]) >= need).tolist()

    def candidates(self, codes: np.ndarray):
        """Yields (start of a passage, item) for what reaches the threshold in a run of terms."""
        n, need = len(codes), self.threshold - 1e-9
        starts = np.arange(0, max(1, n - self.passage + self.stride), self.stride)
        ends = np.minimum(starts + self.passage, n)
        total = np.zeros(n + 1)
        for top in self.top:
            np.cumsum(top[codes], out=total[1:])
            for s in starts[total[ends] - total[starts] >= need].tolist():
                terms = np.unique(codes[s : s + self.passage])
                impact = top[terms]
                if impact.sum() >= need:
                    for item in self.retrieve(terms[impact > 0]):
                        yield s, item


def entries(words: list[str]) -> list[list[str]]:
    """What is searched for of an item: its question and its answer by themselves, as they may stand far apart; an item too short to halve is one entry."""
    half = (len(words) + 1) // 2
    if half < 2 * SHINGLE:
        return [words] if words else []
    return [words[:half], words[half:]]


def verified(own: list[str], shingles: set[tuple[str, ...]], words: list[str], overlap: float) -> tuple[float, float] | None:
    """The shares of the item's question and answer that the document has, if both suffice."""
    half = (len(own) + 1) // 2
    shares = []
    for part in (own[:half], own[half:]):
        if not part:
            continue
        if len(part) < SHINGLE:
            k = len(part)
            shares.append(float(any(words[i : i + k] == part for i in range(len(words) - k + 1))))
        else:
            grams = {tuple(part[i : i + SHINGLE]) for i in range(len(part) - SHINGLE + 1)}
            shares.append(len(grams & shingles) / len(grams))
    if not shares or min(shares) < overlap:
        return None
    return shares[0], shares[-1]


class Index:
    """The tiers of one part of the items; an item's entries are its question and its answer."""

    def __init__(self, items: list[tuple[int | None, str | None]], n_items: int, df: dict[str, int], mean_words: float, threshold: float):
        self.items = [(item, words_of(text)) for item, text in items]
        self.term: dict[str, int] = {}
        tiers: dict[int, list[tuple[int, list[str]]]] = {}
        for i, (_, ws) in enumerate(self.items):
            for w in ws:
                self.term.setdefault(w, len(self.term) + 1)
            for part in entries(ws):
                tiers.setdefault(max(16, 1 << (len(part) - 1).bit_length()), []).append((i, part))
        self.of = {most: [i for i, _ in at] for most, at in tiers.items()}
        self.tiers = {most: Tier([ws for _, ws in at], most, self.term, n_items, df, mean_words, threshold) for most, at in tiers.items()}

    def search(self, docs: list[list[str]], overlap: float):
        """Yields (document, item_id, question, answer) for texts given as words."""
        get = self.term.get
        size = np.fromiter(map(len, docs), np.int64, len(docs))
        ends = np.cumsum(size)
        codes = np.fromiter((get(w, 0) for ws in docs for w in ws), np.int64, int(size.sum()))
        # passages run on over the ends of documents; verification is by document
        pairs = set()
        for most, tier in self.tiers.items():
            of = self.of[most]
            for s, entry in tier.candidates(codes):
                first, last = np.searchsorted(ends, [s, min(s + tier.passage, len(codes)) - 1], "right").tolist()
                pairs.update((d, of[entry]) for d in range(first, last + 1))
        at, shingles = -1, set()
        for d, i in sorted(pairs):
            if d != at:
                at, ws = d, docs[d]
                shingles = {tuple(ws[k : k + SHINGLE]) for k in range(len(ws) - SHINGLE + 1)}
            item, own = self.items[i]
            if found := verified(own, shingles, docs[d], overlap):
                yield d, item, *found


def runs(texts: pa.Array):
    """Yields (first row, words of each row) for runs of about STEP characters."""
    holds("decontaminate")
    out, at, chars = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py()
        out.append(words_of(t))
        chars += len(t or "")
        if chars >= STEP:
            yield at, out
            out, at, chars = [], i + 1, 0
    if out:
        yield at, out


class Parts:
    """The benchmark dealt to parts of bounded size, and its statistics, all kept in Spark.

    ``index(k)`` reads one part and builds its index; a part has about ``PART_ITEMS``
    items and ``PART_CHARS`` characters, so neither the driver nor a broadcast ever
    holds more, however large the benchmark is.
    """

    def __init__(self, benchmark: DataFrame, threshold: float = THRESHOLD):
        self.threshold = threshold
        items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
        self.n, chars, longest = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0)), F.coalesce(F.max(F.length("text")), F.lit(0))).first()
        if longest > PART_CHARS:
            raise ValueError(f"an item of {longest} characters is longer than a part may be")
        # items are dealt by hash, so parts are filled to half on average
        self.count = 1 if self.n <= PART_ITEMS and chars <= PART_CHARS else -(-2 * max(self.n * PART_CHARS, chars * PART_ITEMS) // (PART_ITEMS * PART_CHARS))
        if self.count == 1:
            self.items, self.frequency = items.withColumn("part", F.lit(0)), None
            return
        ship(benchmark.sparkSession)
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.count)).cast("int")
        self.items = stage(items.withColumn("part", part), "items")
        words = self.items.select("part", "text").mapInArrow(_words_of_items, "part int, word string, n long")
        words = stage(words.groupBy("part", "word").agg(F.count("*").alias("df"), F.sum("n").alias("n")), "item-words")
        self.total = words.agg(F.sum("n")).first()[0] or 0
        of_all = words.groupBy("word").agg(F.sum("df").alias("df"))
        self.frequency = stage(words.select("part", "word").join(of_all, "word"), "item-frequency")

    def index(self, k: int) -> Index:
        rows = [(r[0], r[1]) for r in self.items.where(F.col("part") == k).select("item_id", "text").collect()]
        if sum(len(t or "") for _, t in rows) > 4 * PART_CHARS or len(rows) > 4 * PART_ITEMS:
            raise ValueError("a part of the benchmark is over its bound: many equal items")
        if self.frequency is None:
            df: Counter = Counter()
            total = 0
            for _, t in rows:
                ws = words_of(t)
                df.update(set(ws))
                total += len(ws)
        else:
            df = {r.word: r.df for r in self.frequency.where(F.col("part") == k).select("word", "df").collect()}
            total = self.total
        return Index(rows, self.n, df, max(1.0, total / max(1, 2 * self.n)), self.threshold)


def _words_of_items(batches):
    """Rows (part, word, n) of (part, text): each item's words with their number, each once."""
    for batch in batches:
        out = ([], [], [])
        for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in Counter(words_of(text)).items():
                for col, x in zip(out, (part, word, n)):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["part", "word", "n"])


def _hits(index, overlap: float):
    """Rows (key, text): (key, item_id, question, answer)."""

    def run(batches):
        for batch in batches:
            out = []
            keys = batch.column(0).to_pylist()
            for at, words in runs(batch.column(1)):
                out += [(keys[at + d], *rest) for d, *rest in index.value.search(words, overlap)]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["key", "item_id", "question", "answer"])

    return run


def _search(rows: DataFrame, parts: Parts, overlap: float) -> DataFrame:
    """(key, item_id, question, answer) of ``rows`` (key, text): one part after the other, each with its own broadcast."""
    spark = rows.sparkSession
    schema = "key long, item_id long, question double, answer double"
    if parts.count == 1:
        return rows.mapInArrow(_hits(spark.sparkContext.broadcast(parts.index(0)), overlap), schema)
    found = None
    for k in range(parts.count):
        index = spark.sparkContext.broadcast(parts.index(k))
        hits = stage(rows.mapInArrow(_hits(index, overlap), schema), f"hits-{k}")
        index.destroy()
        found = hits if found is None else found.union(hits)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, question, answer): the test items found in each document, with the shares of their halves found."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "text")
    return _search(rows, Parts(benchmark, threshold), overlap).withColumnRenamed("key", "doc_id")


def _clean(index, overlap: float):
    def run(batches):
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for at, words in runs(batch.column("text")):
                for d, *_ in index.value.search(words, overlap):
                    keep[at + d] = False
            yield batch.filter(pa.array(keep))

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` in which no test item is found."""
    spark = docs.sparkSession
    ship(spark)
    parts = Parts(benchmark, threshold)
    if parts.count == 1:
        return docs.mapInArrow(_clean(spark.sparkContext.broadcast(parts.index(0)), overlap), docs.schema)
    key = free_name("key", docs.columns)
    rows = stage(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    hits = _search(rows.select(F.col(key).alias("key"), "text"), parts, overlap).select(F.col("key").alias(key)).distinct()
    return rows.join(hits, key, "left_anti").select(docs.columns)
