"""Token counts under a unigram vocabulary, without making the tokens.

A text is cut before every space; the space becomes U+2581, and each piece is scored for itself. An Aho-Corasick
automaton lists all vocabulary entries in a piece; dynamic programming over its places carries the best score
and the number of tokens. Places are visited from left to right and starts from the farthest; only a strictly
better score replaces, so of equal paths the one whose last token is longest stays, as in the tokenizer library. A
character that no entry starts with alone costs the lowest score less ten and counts as its UTF-8 bytes (byte
fallback). Only the last places, as many as the longest entry has characters, are kept, so a piece of any length takes
little memory. Each different piece is counted once and remembered, `REMEMBERED` of them by a worker at most (20 bytes each).

Vocabulary and scores are read from the file of a public tokenizer; nothing is trained.

Cases: a null or empty text has no tokens and score 0; rows without doc_id are left out; equal rows are counted each;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernel import slices, text_bytes, word_hashes
from .store import documents

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 600_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, score double"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Entries and scores of a piece model, without control and byte entries."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Counter:
    def __init__(self, entries: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for token, score in entries:
            self.automaton.add_word(token, (len(token), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in entries), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(token) for token, _ in entries), default=0)
        self.forget()

    def forget(self) -> None:
        self.tags, self.tokens, self.scores = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0)  # of remembered pieces, by tag

    def count(self, piece: str) -> tuple[int, float]:
        """Tokens and score of one piece."""
        size = self.longest + 1
        best, tokens = [0.0] * size, [0] * size  # by place, the last `size` of them
        hits = self.automaton.iter(piece)
        hit = next(hits, None)
        here = 0
        for end, character in enumerate(piece):  # hits at an end come with the longest first, that is from the farthest start
            top, single, count = None, False, 0
            while hit is not None and hit[0] == end:
                length, score = hit[1]
                single |= length == 1
                start = (end + 1 - length) % size
                value = score + best[start]
                if top is None or value > top:
                    top, count = value, tokens[start] + 1
                hit = next(hits, None)
            if not single:
                value = self.unknown + best[here]
                if top is None or value > top:
                    top, count = value, tokens[here] + len(character.encode())
            here = (end + 1) % size
            best[here], tokens[here] = top, count
        return tokens[here], best[here]

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, tokens and score of each text."""
        raw, at = text_bytes(column)
        n = len(at) - 1
        edge = np.zeros(len(raw) + 1, bool)
        edge[at[:-1][at[:-1] < at[1:]]] = True
        # The first piece of a text that doesn't begin with a space gets a mark of its own.
        bare = edge[: len(raw)] & (raw != 0x20)
        edge[: len(raw)] |= raw == 0x20
        starts = np.flatnonzero(edge[: len(raw)])
        ends = np.append(starts[1:], len(raw))[: len(starts)]
        after = starts + (~bare[starts])
        filled = after < ends
        tags = np.zeros(len(starts), np.uint64)
        tags[filled] = word_hashes(raw, after[filled], ends[filled])
        tags, where, back = np.unique(tags, return_index=True, return_inverse=True)
        if len(self.tags) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.tags, tags)
        inside = np.flatnonzero(place < len(self.tags))
        new = np.ones(len(tags), bool)
        new[inside] = self.tags[place[inside]] != tags[inside]
        if new.any():
            text = raw.tobytes()
            found = [self.count(MARK + text[i:j].decode()) for i, j in zip(after[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
            at_new = place[new]
            self.tags = np.insert(self.tags, at_new, tags[new])
            self.tokens = np.insert(self.tokens, at_new, np.array([n for n, _ in found], np.int32))
            self.scores = np.insert(self.scores, at_new, np.array([x for _, x in found]))
            place = np.searchsorted(self.tags, tags)
        tokens, scores = self.tokens[place][back].astype(np.int64), self.scores[place][back]
        first = np.searchsorted(starts, at)
        total = np.concatenate([[0], np.cumsum(tokens)])
        score = np.array([scores[first[i] : first[i + 1]].sum() for i in range(n)])
        return np.diff(at), total[first[1:]] - total[first[:-1]], score


@cache
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """Tokens and best score of every document; see the module."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for b in slices(batches):
            size, tokens, score = own.rows(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array(size), pa.array(tokens), pa.array(score, pa.float64())], names=["doc_id", "n_bytes", "n_tokens", "score"])

    return documents(docs).mapInArrow(run, SCHEMA)
