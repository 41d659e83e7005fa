"""Line dedup by pairwise alignment: what a document shares with an earlier one goes from the later.

Texts are compared lower-cased, in two kinds of units, each trimmed:

* whole lines, from newline to newline;
* pieces of lines: a line is cut at anchors that its own characters name
  (winnowing: of each ``WINDOW`` places the one whose next ``GRAM`` characters
  hash least), so two texts that share a passage share its cuts, in any language
  and without sentence marks.

A document is later than those of smaller doc_id. What goes from the later one:

* aligned blocks of whole lines with ``LINE_CHARS`` characters or more; with
  ``least_line=1`` every line of the later document that an earlier one has;
* aligned passages within lines of ``MIN_CHARS`` characters or more, wherever
  they begin.

How they are found:

* From each unit a run begins that is just long enough: ``least_line`` characters
  of lines, 5/9 of ``least`` of pieces. Within a line the first anchor of a common
  passage is less than ``WINDOW + GRAM`` characters from its start and the last as
  near to its end, so any common passage of 100 + 2 * 64 + 8 = 236 characters holds
  one run whole, and most of ``MIN_CHARS`` do.
* Every run that at least two documents have is looked up in the first document
  that has it. Runs of pieces, and runs of lines that at most ``RARE`` documents
  have, pair a later document with that first one: a star, never all pairs.
* Runs of lines that more documents have need no alignment, as whole lines have no
  ends to grow: their places were noted with their hashes, and they go from every
  later document by a join. So no frequent line is left out, and none brings
  documents together that have nothing else in common.
* Each pair is aligned by patience diff: units that are unique on both sides and
  in the same order are anchors (found as a longest increasing subsequence),
  grown over equal neighbours, and where an end is no line end, over the equal
  characters of the line, back to the last whole word. Runs that no anchor
  reaches (repeated or moved ones) are then taken one by one, each grown both ways.

A first document with many partners is dealt to several tasks, ``FAN_OUT``
partners each. Texts travel only where they are aligned and shortened. That most
runs occur once is used by a bitmap of fixed size (``BITMAP_BITS``), which lets
most of them stay at home; where it fills up, it lets more pass and nothing is lost.

Defined cases: a null text counts as empty and stays null; rows that share a
doc_id are one place in the order, so neither is later than the other, and of
rows that share text as well each is shortened alike; a null doc_id comes after
all others; doc_ids are cast to long; blank and short lines belong to the block
around them; further columns are kept, save that one which bears the name of an
added column is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, holds, ship, sized

MIN_CHARS, LINE_CHARS, RARE, FAN_OUT, SALTS, BITMAP_BITS = 180, 24, 4, 64, 32, 1 << 26
WINDOW, GRAM = 64, 8
#: Texts of about this many characters are cut together.
STEP = 1 << 19
_UNSPACED = 0x2E80
_LAST = (1 << 63) - 1
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
#: Random values for the hashes of spans and, of 32 bits, for the places of cuts.
_OF_CHAR = np.random.default_rng(5).integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CUT_OF_CHAR = (_OF_CHAR >> np.uint64(32)).astype(np.uint32)
_power = {}


def _powers(r: np.uint64, n: int) -> np.ndarray:
    """r^0, r^1, ...; at least n of them."""
    known = _power.get(int(r))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 12), r, np.uint64)
        known[0] = 1
        known = _power[int(r)] = np.multiply.accumulate(known)
    return known


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def folded(text: str) -> str:
    """The text in lower case, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _sliding(pick, x: np.ndarray, n: int) -> np.ndarray:
    """``pick`` over each n neighbours; n is a power of two."""
    step = 1
    while step < n:
        x = pick(x[:-step], x[step:])
        step *= 2
    return x


class Units:
    """Folded texts end to end, a line end behind each, cut into lines and pieces.

    ``at`` has where each text begins. Of either kind ``starts``, ``of`` (the text),
    ``sizes`` and ``hashes`` (trimmed) and ``last`` (the first unit of the next text).
    """

    def __init__(self, lows: list[str]):
        size = np.fromiter(map(len, lows), np.int64, len(lows))
        self.at = np.concatenate(([0], np.cumsum(size + 1)))
        c = np.frombuffer(("\n".join(lows) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        low = c & np.uint32(0xFFFF)
        v = _OF_CHAR[low]
        cut = _CUT_OF_CHAR[low]
        if int(c.max()) > 0xFFFF:
            plane = c >> np.uint32(16)
            v *= plane.astype(np.uint64) * np.uint64(2) + np.uint64(1)
            cut *= plane * np.uint32(2) + np.uint32(1)
        v *= _powers(_R, len(c))[: len(c)]
        self.weighted = np.empty(len(c) + 1, np.uint64)
        self.weighted[0] = 0
        np.cumsum(v, out=self.weighted[1:])
        solid = (c > 32) & (c != 160) & (c != 0x3000)
        self.solid, self.solid_before = np.append(np.flatnonzero(solid), len(c)), np.cumsum(solid, dtype=np.int32) - solid
        newline = np.flatnonzero(c == 10)
        begins = np.concatenate(([0], newline[:-1] + 1))
        self.lines = Kind(self, begins)
        first = np.zeros(len(c), bool)
        first[begins] = first[_anchors(cut, newline)] = True
        self.pieces = Kind(self, np.flatnonzero(first))


class Kind:
    def __init__(self, units: Units, starts: np.ndarray):
        self.starts = starts
        end = len(units.weighted) - 1
        a = units.solid_before[starts]
        b = np.append(a[1:], len(units.solid) - 1)
        lo = units.solid[a]
        full = b > a
        lo = np.where(full, lo, np.minimum(lo, end))
        hi = np.where(full, units.solid[np.maximum(b - 1, 0)] + 1, lo)
        self.sizes = hi - lo
        self.hashes = _mix((units.weighted[hi] - units.weighted[lo]) * _powers(_R_INVERSE, end + 1)[lo] + self.sizes.astype(np.uint64))
        self.of = np.searchsorted(units.at, starts, "right") - 1
        self.bounds = np.searchsorted(starts, units.at)
        self.last = self.bounds[self.of + 1]

    def text(self, i: int, begin: int, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Hashes and sizes of a text's units, and where they begin and the last one ends."""
        a, b = self.bounds[i], self.bounds[i + 1]
        return self.hashes[a:b].view(np.int64), self.sizes[a:b], [*(self.starts[a:b] - begin).tolist(), size]


def _anchors(h: np.ndarray, newline: np.ndarray) -> np.ndarray:
    """Places at which lines are cut: no anchor reads past its line, and a window with a line end in it has none."""
    n, step = len(h), 1
    if n < WINDOW:
        return np.zeros(0, np.int64)
    h = np.concatenate((h, np.zeros(GRAM, np.uint32)))
    while step < GRAM:
        h = h[:-step] * np.uint32(0x9E3779B1 + 2 * step) + h[step:]
        step *= 2
    h = h[:n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    for back in range(1, GRAM):
        at = newline - back
        h[at[at >= 0]] = np.iinfo(np.uint32).max
    h[newline] = 0
    least = _sliding(np.minimum, h, WINDOW)
    edge = np.zeros(WINDOW - 1, np.uint32)
    anchor = h == _sliding(np.maximum, np.concatenate((edge, least, edge)), WINDOW)
    anchor[1:] &= h[1:] != h[:-1]
    anchor[newline] = False
    return np.flatnonzero(anchor)


def lines_of(text: str) -> list[str]:
    """The text's pieces; end to end they are the text."""
    ends = [*Units([folded(text)]).pieces.starts.tolist()[1:], len(text)]
    return [x for a, b in zip([0, *ends], ends) if (x := text[a:b])]


class Pieces:
    """One of the texts as it is compared; ``at`` has where its pieces begin, ``line_at`` where its lines do."""

    def __init__(self, units: Units, low: str, i: int = 0):
        self.low, begin = low, units.at[i]
        self.hashes, self.sizes, self.at = units.pieces.text(i, begin, len(low))
        self.line_hashes, self.line_sizes, self.line_at = units.lines.text(i, begin, len(low))
        self.known: dict = {}

    def runs(self, lines: bool, least: int):
        """(start, end, hash) of the runs of pieces or lines, and where each hash begins first; worked out once."""
        if (lines, least) not in self.known:
            start, end, h = runs(*((self.line_hashes, self.line_sizes) if lines else (self.hashes, self.sizes)), least)
            self.known[lines, least] = start, end, h, dict(zip(h[::-1].tolist(), start[::-1].tolist()))
        return self.known[lines, least]


def pieces(text: str) -> Pieces:
    low = folded(text)
    return Pieces(Units([low]), low)


def run_chars(least: int) -> int:
    return max(1, least * 5 // 9)


def runs(hashes: np.ndarray, sizes: np.ndarray, least: int, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the run that begins at each unit, where the text is long enough for one. ``last``: where each unit's text ends."""
    n = len(hashes)
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    end = np.searchsorted(total, total[:-1] + least, "left")
    start = np.flatnonzero((end <= (n if last is None else last)) & (sizes > 0))
    end = end[start]
    # the sum of h[start + j] r^j, from running sums: it must not depend on where the run stands
    weighted = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(hashes.view(np.uint64)) * _powers(_R, n)[:n], dtype=np.uint64)))
    own = (weighted[end] - weighted[start]) * _powers(_R_INVERSE, n)[start]
    return start, end, _mix(own + (end - start).astype(np.uint64)).view(np.int64)


def _parts(texts: pa.Array):
    """Yields (first row, folded texts) for runs of rows of about STEP characters."""
    holds("line_dedup", _power.clear)
    out, at, chars = [], 0, 0
    for i, text in enumerate(texts):
        out.append(folded(text.as_py()))
        chars += len(out[-1])
        if chars >= STEP:
            yield at, out
            out, at, chars = [], i + 1, 0
    if out:
        yield at, out


LISTS = "doc long, text_hash long, runs array<long>, line_runs array<long>, line_starts array<int>, line_ends array<int>, fresh array<boolean>"


def _run_lists(least: int, least_line: int):
    """Rows of LISTS of (doc, text_hash, text): the hashes of a text's runs of pieces, each once, and all its runs of lines
    with the characters that they cover; ``fresh`` marks the first of equal ones."""

    def lists(of: np.ndarray, n: int, *columns):
        at = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int32))
        return [pa.ListArray.from_arrays(at, pa.array(c)) for c in columns]

    def new(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order by text and hash, and where in it a pair is the first of its kind."""
        order = np.lexsort((h, of))
        of, h = of[order], h[order]
        return order, np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]

    def work(batches):
        for batch in batches:
            for at, lows in _parts(batch.column(2)):
                own, n = Units(lows), len(lows)
                start, _, h = runs(own.pieces.hashes, own.pieces.sizes, run_chars(least), own.pieces.last)
                of = own.pieces.of[start]
                order, first = new(of, h)
                line, end, g = runs(own.lines.hashes, own.lines.sizes, least_line, own.lines.last)
                line_of = own.lines.of[line]
                line_order, line_first = new(line_of, g)
                fresh = np.zeros(len(g), bool)
                fresh[line_order[line_first]] = True
                begin = own.at[line_of]
                begins = np.append(own.lines.starts, own.at[-1])
                till = np.minimum(begins[end], own.at[line_of + 1] - 1) - begin
                columns = [
                    *lists(of[order][first], n, h[order][first]),
                    *lists(line_of, n, g, (begins[line] - begin).astype(np.int32), till.astype(np.int32), fresh),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), *columns], [x.split()[0] for x in LISTS.split(", ")])

    return work


def _shared_runs(bitmap):
    """Rows (run, doc) of (doc, runs): what the bitmap lets pass."""

    def work(batches):
        bits = bitmap.value
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy()
            h = lists.flatten().to_numpy()
            slot = h.view(np.uint64) % np.uint64(BITMAP_BITS)
            held = np.flatnonzero((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))
            of = np.repeat(np.arange(len(batch)), np.diff(at))[held]
            yield pa.RecordBatch.from_arrays([pa.array(h[held]), batch.column(0).take(pa.array(of))], ["run", "doc"])

    return work


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, that rises in the second (patience sorting)."""
    tops, at, back = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[k], at[k] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _once(keys: list[int]) -> dict[int, int]:
    """Where each key stands that occurs once."""
    out, many = {}, set()
    for i, k in enumerate(keys):
        if k in out:
            many.add(k)
        out[k] = i
    for k in many:
        del out[k]
    return out


def patience_blocks(a: list[int], b: list[int], a_free: list[bool], b_free: list[bool]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, lines) of aligned equal blocks among the free lines."""
    ua, ub = (_once([k if f else -1 - i for i, (k, f) in enumerate(zip(x, free))]) for x, free in ((a, a_free), (b, b_free)))
    anchors = _increasing(sorted((i, ub[k]) for k, i in ua.items() if k in ub and a_free[i] and b_free[ub[k]]))
    out, end_a, end_b = [], 0, 0
    for i, j in anchors:
        if i < end_a or j < end_b:
            continue
        s = 0
        while i - s > end_a and j - s > end_b and a_free[i - s - 1] and b_free[j - s - 1] and a[i - s - 1] == b[j - s - 1]:
            s += 1
        e = 1
        while i + e < len(a) and j + e < len(b) and a_free[i + e] and b_free[j + e] and a[i + e] == b[j + e]:
            e += 1
        out.append((i - s, j - s, s + e))
        end_a, end_b = i + e, j + e
    return out


def align(one: Pieces, other: Pieces, lines: bool, least: int) -> list[tuple[int, int, int]]:
    """(start in one, start in the other, units) of what stands in both, each of ``least`` characters or more.

    One pass of patience diff; then each run that is left by itself, so the work
    grows with the units and not with how often they repeat.
    """
    *_, where = one.runs(lines, least)
    starts, ends, hashes, _ = other.runs(lines, least)
    found = [(s, e, h) for s, e, h in zip(starts.tolist(), ends.tolist(), hashes.tolist()) if h in where]
    if not found:
        return []
    a, (b, b_sizes) = one.line_hashes if lines else one.hashes, (other.line_hashes, other.line_sizes) if lines else (other.hashes, other.sizes)
    x, y, size = a.tolist(), b.tolist(), np.concatenate(([0], np.cumsum(b_sizes))).tolist()
    b_free = [True] * len(y)
    out = []
    for i, j, n in patience_blocks(x, y, [True] * len(x), b_free):
        if size[j + n] - size[j] >= least:
            out.append((i, j, n))
            b_free[j : j + n] = [False] * n
    for s, e, h in found:
        if b_free[s] and all(b_free[s:e]):
            # nothing unique to hold on to: the run by itself, grown both ways
            i, j, n = where[h], s, e - s
            while j and i and b_free[j - 1] and x[i - 1] == y[j - 1]:
                i, j, n = i - 1, j - 1, n + 1
            while j + n < len(y) and i + n < len(x) and b_free[j + n] and x[i + n] == y[j + n]:
                n += 1
            out.append((i, j, n))
            b_free[j : j + n] = [False] * n
    return sorted(out)


def _inside_word(low: str, at: int) -> bool:
    return 0 < at < len(low) and low[at - 1].isalnum() and low[at].isalnum() and ord(low[at - 1]) < _UNSPACED


def common(a: Pieces, b: Pieces, i: int, j: int, n: int) -> tuple[int, int]:
    """The characters of ``b`` that an aligned block covers: from an end within a line on over equal characters, then back to whole words."""
    x, y = a.low, b.low
    s, e = b.at[j], b.at[j + n]
    p, q = a.at[i], a.at[i + n]
    if s and y[s - 1] != "\n":
        while s and p and y[s - 1] == x[p - 1] != "\n":
            s, p = s - 1, p - 1
        whole = s
        while whole < e and _inside_word(y, whole):
            whole += 1
        s = whole if whole < e else s
    if y[e - 1] != "\n":
        while e < len(y) and q < len(x) and y[e] == x[q] != "\n":
            e, q = e + 1, q + 1
        whole = e
        while whole > s and _inside_word(y, whole):
            whole -= 1
        e = whole if whole > s else e
    return s, e


def shared_ranges(a: Pieces, b: Pieces, least: int = MIN_CHARS, least_line: int = LINE_CHARS) -> list[tuple[int, int]]:
    """Ranges of characters of ``b`` that stand in ``a`` as well: passages of ``least`` or more, whole lines of ``least_line`` or more."""
    out = set()
    for i, j, n in align(a, b, False, run_chars(least)):
        s, e = common(a, b, i, j, n)
        if len(b.low[s:e].strip()) >= least:
            out.add((s, e))
    for _, j, n in align(a, b, True, least_line):
        out.add((b.line_at[j], b.line_at[j + n]))
    return sorted(out)


def _all_pieces(texts: pa.Array):
    for at, lows in _parts(texts):
        units = Units(lows)
        for i, low in enumerate(lows):
            yield at + i, Pieces(units, low, i)


def _aligned(least: int, least_line: int):
    """Rows (cell, side, first, doc, text_hash, text), sorted: side 0 is a cell's first document, side 1 are its partners. Gives (doc, text_hash, source, start, end) in code points."""

    def work(batches):
        cell = first = None
        for batch in batches:
            cells, side, source, doc, text_hash = (batch.column(i).to_pylist() for i in range(5))
            out = ([], [], [], [], [])
            for k, own in _all_pieces(batch.column(5)):
                if side[k] == 1 and cell != cells[k]:
                    continue
                if side[k] == 0:
                    # rows that share a doc_id: each is a first document for the cell
                    first = [*first, own] if cell == cells[k] else [own]
                    cell = cells[k]
                else:
                    for f in first:
                        for s, e in shared_ranges(f, own, least, least_line):
                            for col, v in zip(out, (doc[k], text_hash[k], source[k], s, e)):
                                col.append(v)
            if out[0]:
                kinds = [pa.int64()] * 3 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc", "text_hash", "source", "start", "end"])

    return work


def _bitmap(shared: DataFrame) -> np.ndarray:
    slot = F.pmod(F.col("run"), F.lit(BITMAP_BITS))  # the size is a power of two, so signed and unsigned agree
    words = shared.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(run, {BITMAP_BITS}) & 63 AS INT))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS >> 6, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _doc():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def deletions(docs: DataFrame, scratch: Scratch, least: int = MIN_CHARS, least_line: int = LINE_CHARS, fan_out: int = FAN_OUT, rare: int = RARE) -> DataFrame:
    """(doc, text_hash, source, start, end): ranges of code points to delete from each text, and the earlier document that has them.

    A document is known by its id and the hash of its text.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(_doc().alias("doc"), F.xxhash64("text").alias("text_hash"), "text").where(F.length("text") >= min(least, least_line))
    lists = scratch.stage(texts.mapInArrow(_run_lists(least, least_line), LISTS), "runs")
    seen = lists.select("doc", F.explode("runs").alias("run")).groupBy("run").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    shared = scratch.stage(sized(seen.where("first < last").select("run", "first")), "shared-runs")
    bitmap = spark.sparkContext.broadcast(_bitmap(shared))
    mine = lists.select("doc", "runs").mapInArrow(_shared_runs(bitmap), "run long, doc long")
    found = mine.join(shared.hint("merge"), "run").where("first < doc").select("first", "doc")
    lines = lists.select("doc", "text_hash", F.explode(F.arrays_zip("line_runs", "line_starts", "line_ends", "fresh")).alias("x"))
    lines = lines.select("doc", "text_hash", F.col("x.line_runs").alias("run"), F.col("x.line_starts").alias("start"), F.col("x.line_ends").alias("end"), F.col("x.fresh").alias("fresh"))
    seen = lines.groupBy("run").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count_if("fresh").alias("n"))
    shared = scratch.stage(sized(seen.where("first < last").select("run", "first", (F.col("n") <= rare).alias("rare"))), "shared-lines")
    lines = lines.join(shared.hint("merge"), "run").where("first < doc").select("first", "doc", "text_hash", "start", "end", "rare")
    lines = scratch.stage(sized(lines), "found-lines")
    pairs = scratch.stage(sized(found.union(lines.where("rare").select("first", "doc")).distinct()), "pairs")
    common_lines = lines.where("not rare").select("doc", "text_hash", F.col("first").alias("source"), "start", "end")
    # each first document meets its partners in cells of about fan_out; those of many partners are joined by salted keys
    cells = scratch.stage(sized(pairs.groupBy("first").agg(F.ceil(F.count("*") / fan_out).cast("int").alias("cells"))), "cells")
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS))
    wide = cells.where("cells > 1").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    number = F.pmod(F.xxhash64("doc", F.lit(1)), F.coalesce("cells", F.lit(1)).cast("long"))
    placed = pairs.withColumn("salt", salt).join(wide.hint("merge"), ["first", "salt"], "left").withColumn("cell", F.xxhash64("first", number))
    firsts = cells.select("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - F.lit(1).cast("long"))).alias("k")).withColumn("cell", F.xxhash64("first", "k"))
    asked = firsts.select(F.col("first").alias("doc"), "cell", F.lit(0).alias("side"), "first").union(placed.select("doc", "cell", F.lit(1).alias("side"), "first"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = asked.join(texts.hint("merge"), "doc").select("cell", "side", "first", "doc", "text_hash", "text")
    both = both.repartition(n, "cell").sortWithinPartitions("cell", "side")
    return both.mapInArrow(_aligned(least, least_line), "doc long, text_hash long, source long, start int, end int").union(common_lines)


def _kept(batches):
    """Rows (doc, text_hash, ranges, sources): ``kept`` has the place and length of each part that stays, in place of the ranges."""
    for batch in batches:
        kept = []
        for ranges in batch.column(2).to_pylist():
            parts, at = [], 0
            for r in sorted(ranges, key=lambda r: (r["start"], r["end"])):
                if r["start"] > at:
                    parts.append({"at": at, "n": r["start"] - at})
                at = max(at, r["end"])
            parts.append({"at": at, "n": (1 << 31) - 1 - at})
            kept.append(parts)
        kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, kind), batch.column(3)], ["doc", "text_hash", "kept", "sources"])


def dedup_lines(docs: DataFrame, least: int = MIN_CHARS, least_line: int = LINE_CHARS, fan_out: int = FAN_OUT, rare: int = RARE, sources: str = "sources", deleted: str = "chars_deleted") -> DataFrame:
    """``docs`` with ``text`` shortened and two further columns: ``sources`` (doc_ids of the earlier documents, ascending) and ``chars_deleted``."""
    with Scratch(docs.sparkSession) as scratch:
        gone = deletions(docs.select("doc_id", "text"), scratch, least, least_line, fan_out, rare)
        gone = gone.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("ranges"), F.array_sort(F.collect_set("source")).alias("sources"))
        gone = gone.mapInArrow(_kept, "doc long, text_hash long, kept array<struct<at:int,n:int>>, sources array<long>")
        gone = scratch.keep(sized(gone), "deletions")
    own = [c for c in docs.columns if c.lower() not in (sources.lower(), deleted.lower())]
    doc, text_hash, kept, of, short = (free_name(x, docs.columns) for x in ("doc", "text_hash", "kept", "of", "short"))
    # one plan at every size: what is deleted grows with the corpus, so it is never broadcast
    joined = docs.withColumns({doc: _doc(), text_hash: F.xxhash64("text")}).join(gone.toDF(doc, text_hash, kept, of).hint("merge"), [doc, text_hash], "left")
    text = F.when(F.col(kept).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda k: F.substring("text", k["at"] + 1, k["n"])), ""))
    out = joined.withColumn(short, text).select(
        *(F.col(short).alias(c) if c == "text" else F.col(f"`{c}`") for c in own),
        F.coalesce(of, F.array().cast("array<bigint>")).alias(sources),
        F.coalesce(F.length("text") - F.length(short), F.lit(0)).alias(deleted),
    )
    return sized(out)
