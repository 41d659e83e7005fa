"""Token ids of whole texts, by the tokenizers library.

The library spends nearly all its time on the merges of words that it has met
before, so texts are cut at single spaces and each distinct piece is encoded
once for each worker. A space between two other characters always ends a
pre-token in the vocabularies used here; texts with two spaces in a row or the
name of a special token (and, for lower-casing vocabularies, with characters
beyond U+024F) go to the library whole, which reads such names as it always does. The result is that of encoding the whole text, which the tests check.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import holds

#: Distinct pieces that one worker remembers before it starts afresh.
MEMO = 1_000_000
_JOIN = 4000


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # pieces have no special token's name in them; what they spell end to end must not count as one
        self.lib, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        names = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.names = "|".join(re.escape(x) for x in names)
        said = json.loads(open(path, encoding="utf-8").read())
        self.lower = said["normalizer"] is not None
        end = said["model"].get("end_of_word_suffix") or ""
        vocab = said["model"]["vocab"]
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token.removesuffix(end) if end else token)
        self.reset()

    def reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _one_by_one(self, pieces: list[str], lib=None) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in (lib or self.lib).encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode(self, pieces: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end, and how many each has: the pieces are encoded as
        one text and cut apart by the bytes that tokens stand for."""
        ids = np.array(self.lib.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, np.int64)
        ends, upto = np.cumsum(sizes), np.cumsum(self.width[ids])
        cut = np.searchsorted(upto, ends, "left") + 1
        if len(ids) and upto[-1] == ends[-1] and (sizes > 0).all() and (upto[cut - 1] == ends).all():
            return ids.astype(np.uint32), np.diff(cut, prepend=0)
        each = self._one_by_one(pieces)
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def _learn(self, pieces: list[str]) -> None:
        text = pa.array(pieces)
        if self.lower:
            text = pc.replace_substring_regex(text, "\\s", "")
        sizes = pc.binary_length(text).to_numpy().astype(np.int64)
        done = [self._encode(pieces[i : i + _JOIN], sizes[i : i + _JOIN]) for i in range(0, len(pieces), _JOIN)]
        self.memo.update(zip(pieces, range(len(self.memo), len(self.memo) + len(pieces))))
        self.flat = np.concatenate([self.flat, *(x for x, _ in done)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate([n for _, n in done]))])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text; a null counts as empty."""
        given = texts = pc.fill_null(texts, "")
        odd = pc.match_substring(texts, "  ")
        if self.names:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.names, ignore_case=self.lower))
        if self.lower:
            odd = pc.or_(odd, pc.match_substring_regex(texts, "[^\\x00-\\x{12F}\\x{132}-\\x{24F}]"))
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if self.lower:
            texts = pc.utf8_lower(texts)
        cut = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        starts = cut.offsets.to_numpy()
        code = pc.dictionary_encode(cut.flatten())
        # only a text's first piece has no space before it
        words, codes = code.dictionary.to_pylist(), code.indices.to_numpy()
        if len(self.memo) > MEMO:
            self.reset()
        first = codes[starts[:-1]]
        spaced = [" " + w for w in words]
        heads = [words[i] for i in first.tolist()]
        asked = spaced + heads
        unknown = list({w: 0 for w in asked if w not in self.memo})
        if unknown:
            self._learn(unknown)
        row = np.fromiter(map(self.memo.__getitem__, asked), np.int64, len(asked))
        row, of_first = row[: len(spaced)][codes], row[len(spaced) :]
        row[starts[:-1]] = of_first
        off, flat = self.offsets, self.flat
        n = off[row + 1] - off[row]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.arange(total[-1]) + np.repeat(off[row] - total[:-1], n)]
        out = np.split(ids, total[starts[1:-1]])
        for i, ids in zip(whole.tolist(), self._one_by_one(given.take(pa.array(whole)).to_pylist(), self.plain) if len(whole) else ()):
            out[i] = ids
        return out


_KEPT: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder; what it has learnt lasts from task to task."""
    holds("tokens", _KEPT.clear)
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


#: Bytes of text that are encoded together.
STEP = 8 << 20


def encode_all(path: str, texts: pa.Array):
    """Yields (first row, ids of each row) for runs of rows of about STEP bytes."""
    lib = encoder(path)
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + STEP, "right")))
        yield at, lib.encode(texts.slice(at, to - at))
        at = to
