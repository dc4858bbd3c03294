"""Byte-level BPE ids of whole texts, with every distinct word encoded once per task."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

# Words whose ids a process remembers, and characters that are split at once.
KNOWN = 500_000
BATCH = 1 << 19
# Code points below this are split by table; texts with others, or with an added token of the
# file, go to the tokenizer whole.
TABLE = 0x250
# White space below TABLE, and the endings that the pattern splits off.
SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0)
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
LETTER, NUMBER, OTHER, SPACE, BREAK = 1, 2, 3, 4, 5
_BASE = 0x9E3779B97F4A7C15


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    return np.array([SPACE if c in SPACES else kinds.get(unicodedata.category(chr(c))[0], OTHER)
                     for c in range(TABLE)], np.uint8)


def _byte_signs() -> dict[str, int]:
    """The printable sign that a byte-level vocabulary writes for each byte."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    signs = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return signs | {chr(256 + i): b for i, b in enumerate(rest)}


def _merger(tokenizer):
    """The same merges in a library that is faster on single words, else None.

    It takes the id of a token as the rank of its merge, so it is used only if the file's
    merges are listed in the order of the ids they make.
    """
    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    signs, vocab = _byte_signs(), model["vocab"]
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")))
            for m in model["merges"]]
    if made != list(range(256, 256 + len(made))):
        return None
    ranks = {bytes(signs[c] for c in token): i for token, i in vocab.items()
             if i < 256 + len(made)}
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks,
                             special_tokens={})


def word_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Mask of the positions where the tokenizer's pattern starts a word.

    Words are an apostrophe with one of ENDINGS; runs of letters, of numbers, or of other
    signs, each with one plain blank before it; and runs of white space, from which the last
    one stands apart if a sign follows. Positions of kind BREAK separate texts.
    """
    n = len(points)
    starts = np.ones(n, bool)
    starts[1:] = kind[1:] != kind[:-1]
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BREAK)
    starts |= last
    starts[1:] &= ~(last[:-1] & (points[:-1] == 32))
    for i in np.flatnonzero((points == 39) & starts).tolist():
        tail = "".join(map(chr, points[i + 1:i + 3].tolist()))
        size = next((len(e) for e in ENDINGS if tail.startswith(e)), 0)
        if size:
            starts[i + 1:i + 1 + size] = False
            starts[i + 1 + size:i + 2 + size] = True
    return starts


class WordEncoder:
    """Ids of texts: words are split and hashed by array operations, and looked up by hash.

    Only words not seen before are encoded: merges never leave a word, so it has the ids that
    it has inside a text. The key of a word is 64 bits of a polynomial over
    its code points mixed with its length.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Added tokens of the file are found in whole texts before these are split into words.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merger = _merger(self.tokenizer)
        self.classes = _classes()
        self.powers = self.inverse = np.zeros(0, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = [np.zeros(0, np.uint32)] * len(texts)
        group, size = [], 0
        for i, text in enumerate(texts):
            split = text.isascii() or max(text) < chr(TABLE)
            if split and not any(t in text for t in self.added):
                group.append(i)
                size += len(text) + 1
            else:
                out[i] = np.array(
                    self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            if size >= BATCH:
                self._encode(texts, group, out)
                group, size = [], 0
        if group:
            self._encode(texts, group, out)
        return out

    def _encode(self, texts: list[str], group: list[int], out: list[np.ndarray]) -> None:
        if len(self.keys) > KNOWN:
            self._forget()
        joined = "\n".join([texts[i] for i in group]) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(texts[i]) + 1 for i in group]) - 1
        kind = self.classes[points]
        kind[ends] = BREAK
        first = np.flatnonzero(word_starts(points, kind) | (kind == BREAK))
        stop = np.append(first[1:], len(points))
        key = self._keys(points, first, stop)
        values, where, back = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, values)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == values[known]
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(values[new], [joined[first[w]:stop[w]] for w in where[new].tolist()])
            place = np.searchsorted(self.keys, values)
        at, size = self.at[place], self.size[place]
        # A line feed of a text has the key of a separator, so separators are told by kind.
        n = np.where(kind[first] == BREAK, 0, size[back])
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(at[back] - total[:-1], n) + np.arange(total[-1])]
        bounds = np.concatenate([[0], total[np.searchsorted(first, ends)]])
        for i, a, b in zip(group, bounds[:-1], bounds[1:], strict=True):
            out[i] = ids[a:b]

    def _keys(self, points: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if len(points) > len(self.powers):
            n = max(len(points), 2 * BATCH)
            for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                row = np.full(n, base, np.uint64)
                row[0] = 1
                setattr(self, name, np.cumprod(row, dtype=np.uint64))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * self.powers[:len(points)], out=sums[1:])
        key = (sums[stop] - sums[first]) * self.inverse[first]
        key ^= (stop - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return key ^ (key >> np.uint64(31))

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        if self.merger is not None:
            ids = [self.merger.encode_ordinary(w) for w in words]
        else:
            found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
            ids = [x.ids for x in found]
        size = np.array([len(x) for x in ids])
        flat = np.array([y for x in ids for y in x], np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        spot = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, spot, keys)
        self.at = np.insert(self.at, spot, at)
        self.size = np.insert(self.size, spot, size)
