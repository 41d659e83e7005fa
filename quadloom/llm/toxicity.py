"""Toxicity from class-conditional Kneser-Ney models.

Two character models of words, one learnt from toxic and one from ordinary
documents, give each word a log-likelihood under either. A character is
predicted from the word so far, and from the ninth character on from the
``DEPTH`` - 1 before it, so ``DEPTH`` bounds the context and every character counts:

    P_c(x | p) = max(n_c(px) - D, 0) / n_c(p) + sum_y min(n_c(py), D) / n_c(p) * P(x | p)

Ordinary counts are scaled to the toxic total, else the larger class would back
off less and every new word would speak for the smaller one. P(x | p) is the same over the counts of both classes, and backs off to
continuation counts: in how many different words-so-far a character follows the
last two, then in how many such contexts it occurs at all. So an expression that
one class has not seen costs what the shared counts say, and rare inflections of
a known stem are still told from ordinary words.

A word counts once for each document that has it. A document's evidence is the
length-normalised difference of its two log-likelihoods, over the whole text,
over the words that stand out, and over the most toxic window of ``WINDOW``
words, with the sums over the words that stand out, over each of them once, and
how many they are. A logistic curve turns these
into a score; it is fitted to at
most ``CALIBRATION_ROWS`` labelled documents (those of the least hash) of a fold
that the counts do not come from.

The discount D is ``DISCOUNT``, chosen on the folds that may be learnt from. (The
usual n1 / (n1 + 2 n2) is 0.74 here and gave more false alarms, 2.0 % for 1.8 %: a
continuation that one document has is hardly evidence.) All counts come from every labelled document of the training folds. They are
kept under their own 64-bit keys, in sorted tables that grow with what is
learnt from, so a context that was not seen is told from all others at every
size. The tables are broadcast.

Defined cases: a null or empty text has no evidence and gets the score of none;
of several labels of one doc_id the highest holds; null labels do not count;
without labels of both classes every score is the training share of toxic rows
(0 if there are none); a null doc_id is never held out; further columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import holds, ship, sized, stage

DEPTH, DISCOUNT, LOW_DISCOUNT, WINDOW = 8, 0.99, 0.75, 64
CALIBRATION_ROWS = 20_000
#: Labels are broadcast up to this many rows, else joined by a shuffle.
LABELS_BROADCAST = 2_000_000
_PUNCT = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’¿¡…–—"
_MEMO_WORDS = 1_000_000
#: Steps beyond a word's DEPTH-th that are worked on at once.
_STEPS = 1 << 20
FEATURES = ("mean", "strong", "peak", "sum", "kinds", "kinds_sum")
#: A word stands out by more than STRONG and counts for CAP at most; chosen on the folds that may be learnt from.
STRONG, CAP = 1.2, 3.0


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEED, _SLIDING, _STEP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F, 0xD1342543DE82EF95))


def steps(words: list[str]):
    """In several parts: (word of each step, context hash, hash with the next character, last two characters and the next).

    A word's end is a step too. The first part has each word's first step; a word
    may have many steps in the last one.
    """
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    chars = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.full(len(words), _SEED, np.uint64)
    alive = np.arange(len(words))
    a = b = np.zeros(len(words), np.uint64)
    for k in range(DEPTH):
        c = chars[start[alive] + k]
        child = _mix(h + (c + np.uint64(1)) * _STEP)
        yield alive, h, child, a, b, c
        go = size[alive] > k + 1
        alive, h, a, b = alive[go], child[go], b[go], c[go]
    word = np.repeat(np.arange(len(words)), size)
    at = np.flatnonzero(np.arange(len(chars)) - start[word] >= DEPTH)
    for lo in range(0, len(at), _STEPS):
        part = at[lo : lo + _STEPS]
        h = np.full(len(part), _SLIDING, np.uint64)
        for back in range(DEPTH - 1, 0, -1):
            h = _mix(h + (chars[part - back] + np.uint64(1)) * _STEP)
        yield word[part], h, _mix(h + (chars[part] + np.uint64(1)) * _STEP), chars[part - 2], chars[part - 1], chars[part]


def _tri(a, b, c):
    return (a << np.uint64(42)) | (b << np.uint64(21)) | c


def _count_words(batches):
    """Rows (text, toxic): (word, t, o) counts of a task's texts."""
    count = (Counter(), Counter())

    def rows():
        words = list(count[0].keys() | count[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([count[1][w] for w in words], pa.int64()), pa.array([count[0][w] for w in words], pa.int64())], ["word", "t", "o"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            count[toxic].update(set((text.as_py() or "").lower().split()))
            if len(count[0]) + len(count[1]) > 400_000:
                yield rows()
                count[0].clear(), count[1].clear()
    yield rows()


def _prefixes(batches):
    """Rows (word, t, o): (h, parent, tri, t, o) of each word's beginnings."""
    for batch in batches:
        words = [w.strip(_PUNCT) or w for w in batch.column(0).to_pylist()]
        t, o = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        cols = [[] for _ in range(5)]
        for alive, parent, child, a, b, c in steps(words):
            key, first, back = np.unique(child, return_index=True, return_inverse=True)
            for col, x in zip(cols, (key, parent[first], _tri(a, b, c)[first], np.bincount(back, t[alive], len(key)).astype(np.int64), np.bincount(back, o[alive], len(key)).astype(np.int64))):
                col.append(x)
        cols = [np.concatenate(c) for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], ["h", "parent", "tri", "t", "o"])


class Table:
    """Columns of numbers under 64-bit keys; a key that is not there reads as zeros."""

    def __init__(self, keys: np.ndarray, columns: list[np.ndarray]):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.columns = [np.append(c[order], 0).astype(np.float32) for c in columns]

    def at(self, keys: np.ndarray) -> list[np.ndarray]:
        keys = keys.view(np.int64)
        place = np.searchsorted(self.keys, keys)
        place[place == len(self.keys)] = -1
        if len(self.keys):
            place[self.keys[place] != keys] = -1
        return [c[place] for c in self.columns]


class Model:
    """Count tables, and what they say about words. ``tables``: columns of numbers by name, the first of each the key."""

    def __init__(self, tables: dict[str, pa.Table], discount: float):
        self.name, self.discount = uuid.uuid4().hex, discount

        def table(name):
            key, *columns = (c.to_numpy() for c in tables[name].columns)
            return Table(key, columns)

        self.child, self.parent, self.tri, self.ctx, self.uni = map(table, ("child", "parent", "tri", "ctx", "uni"))
        self.uni_total = max(1.0, float(self.uni.columns[0].sum()))

    def evidence(self, words: list[str]) -> np.ndarray:
        """log P_toxic - log P_ordinary of each word."""
        out = np.zeros(len(words))
        for alive, parent, child, a, b, c in steps(words):
            tri = _tri(a, b, c)
            low = np.maximum(self.uni.at(c)[0], 0.5) / self.uni_total
            n, types = self.ctx.at(tri >> np.uint64(21))
            some = np.maximum(n, 1)
            low = np.where(n > 0, np.maximum(self.tri.at(tri)[0] - LOW_DISCOUNT, 0) / some + LOW_DISCOUNT * types / some * low, low)

            def backed(count, total, mass, low):
                some = np.maximum(total, 1e-6)
                return np.where(total > 0, np.maximum(count - self.discount, 0) / some + np.minimum(mass / some, 1) * low, low)

            counts, (*totals, toxic, ordinary, both) = self.child.at(child), self.parent.at(parent)
            low = backed(counts[0] + counts[1], totals[0] + totals[1], both, low)
            p = [backed(counts[i], totals[i], mass, low) for i, mass in enumerate((toxic, ordinary))]
            out += np.bincount(alive, np.log(np.maximum(p[0], 1e-12)) - np.log(np.maximum(p[1], 1e-12)), len(words))
        return np.clip(out, -3, 8)


_SEEN: dict[str, dict[str, float]] = {}


def _memo(model: Model) -> dict[str, float]:
    holds("toxicity", _SEEN.clear)
    if model.name not in _SEEN:
        _SEEN.clear()
        _SEEN[model.name] = {}
    if len(_SEEN[model.name]) > _MEMO_WORDS:
        _SEEN[model.name].clear()
    return _SEEN[model.name]


def text_evidence(model: Model, texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text. A text's median evidence is what its language and
    topic say; only words that stand out from it count for all but the first. No word
    counts for more than CAP, or one that a single document is known for would decide."""
    memo = _memo(model)
    words = [(t or "").lower().split() for t in texts]
    new = list({w for ws in words for w in ws if w not in memo})
    for at in range(0, len(new), 100_000):
        part = new[at : at + 100_000]
        memo.update(zip(part, model.evidence([w.strip(_PUNCT) or w for w in part]).tolist()))
    out = np.zeros((len(texts), len(FEATURES)))
    for i, ws in enumerate(words):
        if ws:
            e = np.fromiter(map(memo.__getitem__, ws), np.float64, len(ws))
            strong = np.maximum(np.minimum(e - np.median(e), CAP) - STRONG, 0)
            kinds = {ws[k]: strong[k] for k in np.flatnonzero(strong).tolist()}
            total = np.concatenate(([0.0], np.cumsum(strong)))
            size = min(WINDOW, len(ws))
            out[i] = e.mean(), total[-1] / len(ws), (total[size:] - total[:-size]).max() / WINDOW, np.log1p(total[-1]), np.log1p(len(kinds)), np.log1p(sum(kinds.values()))
    return out


def _evidence_rows(model):
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found = text_evidence(model.value, part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], ["toxic", *FEATURES])

    return run


def train(docs: DataFrame, labels: DataFrame, counted: Column, calibrated: Column):
    """(model broadcast, weights): learns from the labelled rows that ``counted`` holds for, fits the curve where ``calibrated`` does."""
    spark = docs.sparkSession
    ship(spark)
    labels = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.least(F.max("toxic"), F.lit(1)).alias("toxic"))
    labels = stage(sized(labels), "labels")
    small = labels.count() <= LABELS_BROADCAST
    docs = docs.select("doc_id", "text")

    def labelled(rule):
        # the rule holds for an id wherever it stands, so both sides shrink before they meet
        return docs.where(rule).join(F.broadcast(labels.where(rule)) if small else labels.where(rule), "doc_id").select("text", "toxic")

    words = labelled(counted).mapInArrow(_count_words, "word string, t long, o long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    words = stage(sized(words), "words")
    totals = tuple(x or 0 for x in words.agg(F.sum("t"), F.sum("o")).first())
    long5 = "h long, parent long, tri long, t long, o long"
    known = words.mapInArrow(_prefixes, long5).groupBy("h").agg(F.first("parent").alias("parent"), F.first("tri").alias("tri"), F.sum("t").alias("t"), F.sum("o").alias("o"))
    known = stage(sized(known), "prefixes")
    discount = DISCOUNT
    o = F.col("o") * F.lit(totals[0] / max(totals[1], 1))  # brings ordinary counts to the toxic total

    def total(x):
        return F.sum(x).cast("float")

    most = F.lit(discount)
    low = stage(sized(known.groupBy("tri").agg(F.count("*").alias("n"))), "endings")
    tables = {
        "child": known.select("h", F.col("t").cast("float"), o.cast("float")),
        "parent": known.groupBy("parent").agg(total("t"), total(o), total(F.least("t", most)), total(F.least(o, most)), total(F.least(F.col("t") + o, most))),
        "tri": low.select("tri", F.col("n").cast("float")),
        "ctx": low.groupBy(F.shiftrightunsigned("tri", 21)).agg(total("n"), F.count("*").cast("float")),
        "uni": low.groupBy(F.col("tri").bitwiseAND(F.lit(0x1FFFFF))).agg(total("n")),
    }
    model = spark.sparkContext.broadcast(Model({k: x.toDF("key", *(f"c{i}" for i in range(len(x.columns) - 1))).toArrow() for k, x in tables.items()}, discount))
    # the rows of the least hashes: a bound for each task first, then for all, and dealt to many tasks again
    cpus = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = labelled(calibrated).withColumn("at", F.xxhash64("text")).orderBy("at").limit(CALIBRATION_ROWS).select("text", "toxic").repartition(cpus)
    found = sample.mapInArrow(_evidence_rows(model), "toxic int, " + ", ".join(f"{c} double" for c in FEATURES)).toArrow()
    x = np.stack([found.column(c).to_numpy() for c in FEATURES], 1)
    return model, fit(x, found.column("toxic").to_numpy().astype(float))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights (one for each column, then the constant) of a logistic curve, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.02
        w[-1] = np.log(share / (1 - share))
        return w
    scale = np.append(x[:, :-1].std(axis=0) + 1e-9, 1.0)
    z = x / scale
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        pull = ridge * np.append(np.ones(len(w) - 1), 0) * len(y) / 100
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-9), z.T @ (y - p) - pull * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def _scores(model, weights, name):
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found = text_evidence(model.value, part.column("text").to_pylist())
                score = 1 / (1 + np.exp(-np.clip(found @ weights[:-1] + weights[-1], -30, 30)))
                yield part.append_column(name, pa.array(score))

    return run


def score(docs: DataFrame, model, weights: np.ndarray, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``; a column of that name in ``docs`` is replaced."""
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(_scores(model, weights, name), schema)
