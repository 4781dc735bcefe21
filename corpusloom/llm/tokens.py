"""Byte-level BPE ids of whole texts, from the file of a public tokenizer.

Texts are split by the tokenizer's own pattern, vectorised over a slice; each different piece is encoded once
and remembered in sorted arrays, `REMEMBERED` pieces and `MOST_IDS` ids at most. A text with characters outside the
table of classes, or with the string of a special token, goes through the tokenizer library itself, so that all ids are
the library's; it is loaded when the first such text comes.

A text of more than `CHUNK` bytes is encoded in stretches that begin with a blank after another character: no piece of
the pattern goes across such a place, so the ids are the same.
"""

from __future__ import annotations

import json
from functools import cache, cached_property

import numpy as np
import pyarrow as pa

from .kernel import text_bytes, word_hashes

#: Code points whose class is tabled; others go to the library.
TABLED = [(0x0000, 0x3000), (0x3000, 0x3100), (0x3400, 0x4DB6), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0xFF00, 0xFFF0)]
LETTER, NUMBER, SPACE, OTHER, ODD = 1, 2, 3, 0, 9
#: Pieces and ids that a worker remembers; some 10 MB.
REMEMBERED, MOST_IDS = 200_000, 1_500_000
#: Bytes of one text that are encoded at once.
CHUNK = 2 << 20


class ByteBpe:
    def __init__(self, path: str):
        import regex
        import tiktoken

        self.path = path
        spec = json.loads(open(path, encoding="utf-8").read())
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that byte-level vocabularies write as themselves
        of = {chr(b): b for b in visible}
        of |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in of for c in t)}
        ranks = {t: i for t, i in ranks.items() if t not in self.special}
        self.piece = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        points = "".join(chr(c) for a, b in TABLED for c in range(a, b))
        self.kind = np.full(0x10000, ODD, np.uint8)
        for kind, pattern in ((OTHER, r"[\s\S]"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            self.kind[[ord(c) for c in regex.findall(pattern, points)]] = kind
        self.forget()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        self.tags = np.zeros(0, np.uint64)  # fingerprints of remembered pieces, sorted
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # where each one's ids are in flat
        self.flat = np.zeros(0, "<u4")

    def learn(self, tags: np.ndarray, pieces: list[bytes]) -> None:
        """Remember pieces, given by sorted fingerprints that aren't known."""
        found = list(map(self.piece, pieces))
        size = np.array(list(map(len, found)), np.int64)
        first = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.array([i for ids in found for i in ids], "<u4")])
        at = np.searchsorted(self.tags, tags)
        self.tags, self.first, self.size = np.insert(self.tags, at, tags), np.insert(self.first, at, first), np.insert(self.size, at, size)

    def bounds(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where pieces start, for code points and the offsets of rows: the pattern ` ?L+| ?N+| ?O+|\\s+(?!\\S)|\\s+` and contractions."""
        n = len(points)
        kind = self.kind[np.minimum(points, 0xFFFF)]
        edge = np.zeros(n + 1, bool)
        edge[rows] = True
        edge = edge[:n]
        start = edge.copy()
        start[1:] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        next_word = np.zeros(n, bool)  # the last white space before a word
        next_word[:-1] = space[:-1] & ~space[1:] & ~edge[1:]
        start |= next_word
        joined = next_word & (points == 0x20)
        after = np.flatnonzero(joined) + 1
        start[after] = False
        quote = np.flatnonzero((points == 0x27) & start)
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == LETTER) & ~edge[quote + 1]]
        for q in quote.tolist():
            end = int(rows[np.searchsorted(rows, q, "right")])
            two = "".join(map(chr, points[q + 1 : min(q + 3, end)]))
            m = 2 if two[:1] in "stmd" else 3 if two in ("re", "ve", "ll") else 0
            if m:
                start[q + 1] = False
                if q + m < end and kind[q + m] == LETTER:
                    start[q + m] = True
        return np.flatnonzero(start)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the offsets of texts."""
        raw, at = text_bytes(column)
        if len(at) == 2 and len(raw) > CHUNK and not any(s in raw.tobytes() for s in self.special):
            found = [self.slice(raw[i:j], np.array([0, j - i]))[0] for i, j in self.chunks(raw)]
            ids = np.concatenate(found)
            return ids, np.array([0, len(ids)])
        return self.slice(raw, at)

    @staticmethod
    def chunks(raw: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of about CHUNK bytes of one text; each but the first begins with a blank after another character."""
        cuts, at = [0], CHUNK
        while at < len(raw):
            part = raw[at : at + CHUNK]
            seen = np.flatnonzero((part[1:] == 0x20) & (part[:-1] > 0x20) & (part[:-1] < 0x7F))
            if len(seen):
                cuts.append(at + int(seen[0]) + 1)
                at = cuts[-1]
            at += CHUNK
        return list(zip(cuts, [*cuts[1:], len(raw)], strict=True))

    def slice(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = raw.tobytes()
        points = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), "<u4")
        firsts = np.flatnonzero((raw & 0xC0) != 0x80)  # each code point's first byte
        rows = np.searchsorted(firsts, at)
        unknown = np.flatnonzero(self.kind[np.minimum(points, 0xFFFF)] == ODD)
        odd = set((np.searchsorted(rows, np.unique(unknown), "right") - 1).tolist())
        if any(s in text for s in self.special):
            odd |= {i for i in range(len(at) - 1) if any(s in text[at[i] : at[i + 1]] for s in self.special)}
        if odd and len(odd) == len(at) - 1:
            return self.by_library([text[at[i] : at[i + 1]] for i in range(len(at) - 1)])
        begin = self.bounds(points, rows)
        starts = firsts[begin] if len(begin) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        tags, where, back = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        if len(self.tags) > REMEMBERED or len(self.flat) > MOST_IDS:
            self.forget()
        which = np.searchsorted(self.tags, tags)
        known = np.zeros(len(tags), bool)
        inside = which < len(self.tags)
        known[inside] = self.tags[which[inside]] == tags[inside]
        new = np.flatnonzero(~known)
        if len(new):
            self.learn(tags[new], [text[i:j] for i, j in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
            which = np.searchsorted(self.tags, tags)
        first, sizes = self.first[which], self.size[which]
        lengths = sizes[back]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.arange(before[-1]) + np.repeat(first[back] - before[:-1], lengths)] if len(back) else np.zeros(0, "<u4")
        offsets = before[np.searchsorted(starts, at)]
        if odd:
            texts = [ids[offsets[i] : offsets[i + 1]] if i not in odd else self.by_library([text[at[i] : at[i + 1]]])[0] for i in range(len(at) - 1)]
            ids, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
        return ids, offsets

    def by_library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, "<u4") for e in self.library.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        return np.concatenate(found), np.cumsum([0, *map(len, found)])


@cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
