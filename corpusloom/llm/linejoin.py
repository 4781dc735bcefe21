"""Line dedup by an exact set-similarity join of lines.

A line is a text's part between newlines; its tokens are the distinct words of `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. A
line is removed if an earlier line (by doc_id, then place) has 100 * intersection >= percent * union of tokens.
Lines are judged on the input. Lines of fewer than `least` words are left alone; the registered queries join lines of every length.

Tokens are ordered by rarity over the whole corpus. Lines that are similar enough share one of their rarest tokens
(prefix filter); lengths, the token's place in both lines and parity signatures rule out most others. A signature has 64 bits,
and for longer lines so many more that unlike lines differ in more bits than like ones may (`width`). What
remains is verified on full token sets, made from the texts of both lines. Lines of equal token sets have equal content (64 bits), size, signature and rarest token; they are copies.

For each line and list the first earlier line that passes the filters is a candidate; of these the one that most lists
give is verified. A line that isn't removed by it is compared with all its other candidates in a second round: those of
other lists, and those that the first round's lists hold besides; it keeps these lists. So large groups of copies cost a few comparisons a line, and nothing is left out.

Cases: a null or empty text has no lines; equal lines are copies, the first stays; equal rows of one doc_id count
as one document and are treated alike; different texts of one doc_id are one document, the texts in the order of their
SHA-256; rows without doc_id are left out; an empty table gives no rows; further columns are
ignored by dedup_lines and kept by without_repeated_lines, which drops documents of which nothing remains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .kernel import SPACES, U64, mix, ranges, slices, text_bytes, word_bounds, word_hashes
from .rarity import SLOT_BITS, Rarity, gather, send, slots
from .repeats import BLOBS, COVERED, TEXT, buckets_of, by_part, first_of, grouped, meet, stretches
from .store import Scratch, documents, pack, parts, table_rows, unpack, with_bases, with_ids

FLUSH = 16 << 20
TAG_BITS, LINE_BITS = 38, 18
#: Members of a short list; lines of a long list that are looked at at once, against so many others.
SHORT, BLOCK, HUBS = 64, 1 << 20, 256
#: Pairs that a task holds before it sends them.
SENT = 1 << 20
POSTED, ASKING, EARLIER, LATER, LIST, SET, FOUND, OTHER = 3, 4, 5, 6, 7, 8, 10, 11
#: For a pair: no list has more candidates.
NONE = -1
SCHEMA = "doc_id long, n_lines long, n_removed long, kept_sha256 string"


@dataclass(frozen=True)
class Lines:
    percent: int = 80
    least: int = 5


def line_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word; and of each line that has words: row, place in its row, number of words."""
    starts, ends, first = word_bounds(raw, at, SPACES)
    words = word_hashes(raw, starts, ends, lower=True)
    newlines = np.concatenate([[0], np.cumsum(raw == 0x0A)])
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    line = newlines[starts] + row
    head = np.flatnonzero(first_of(line))
    row = row[head]
    return words, row, newlines[starts[head]] - newlines[at[row]], np.diff(np.append(head, len(words)))


def count_tokens(docs: DataFrame, scratch: Scratch) -> Rarity:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int32)
        for b in slices(batches):
            raw, at = text_bytes(b.column("text"))
            starts, ends, _ = word_bounds(raw, at, SPACES)
            counts += np.bincount(slots(word_hashes(raw, starts, ends, lower=True)), minlength=1 << SLOT_BITS).astype(np.int32)
        yield send(counts)

    return gather(docs.mapInArrow(run, BLOBS), scratch)


def ordered(words: np.ndarray, n: np.ndarray, rarity: Rarity) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of lines, rarest first: the line of each and a number that sorts by rarity."""
    token = rarity.of(words).astype(U64) << U64(TAG_BITS) | words >> U64(64 - TAG_BITS)
    line = np.repeat(np.arange(len(n), dtype=U64), n)
    key = np.sort(line << U64(TAG_BITS + 8) | token)
    key = key[first_of(key)]
    return (key >> U64(TAG_BITS + 8)).astype(np.int64), key & U64((1 << (TAG_BITS + 8)) - 1)


def width(size: np.ndarray) -> np.ndarray:
    """64-bit words of a line's signature: 1, 2, 4, 8 or 16, for up to 64, 140, 280, 560 and more tokens."""
    return np.int64(1) << np.searchsorted(WIDER, size)


WIDER = np.array([64, 140, 280, 560])


def signatures(line: np.ndarray, hashed: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Words of all lines' signatures: bits that an odd number of a line's tokens falls on. Folding one in halves gives the narrower one."""
    first = np.cumsum(words) - words
    bit = (first[line] + (hashed >> U64(6)).astype(np.int64) % words[line]) * 64 + (hashed & U64(63)).astype(np.int64)
    odd = np.bincount(bit, minlength=int(words.sum()) * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64)


def needed(m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that sets of m and n share at least, to be similar enough."""
    return -(-percent * (m + n) // (100 + percent))


def prefixes(raw: np.ndarray, at: np.ndarray, rarity: Rarity, like: Lines) -> Iterator[tuple[dict[str, np.ndarray], dict[str, np.ndarray]]]:
    """Per slice: of each line its row, place, size, folded signature, content and where its signature begins in `words`; and the tokens of the lines' prefixes, with line and place among the line's."""
    words, row, place, n = line_words(raw, at)
    word = np.concatenate([[0], np.cumsum(n)])
    for low in range(0, len(n), 1 << LINE_BITS):
        high = min(len(n), low + (1 << LINE_BITS))
        own = n[low:high]
        live = own >= like.least
        if not live.any():
            continue
        spoken = words[word[low] : word[high]]
        if not live.all():
            spoken = spoken[np.repeat(live, own)]
        line, token = ordered(spoken, own[live], rarity)
        new = np.flatnonzero(first_of(line))
        size = np.diff(np.append(new, len(line)))
        words_each = width(size)
        wide = signatures(line, mix(token), words_each)
        sig = np.bitwise_xor.reduceat(wide, np.cumsum(words_each) - words_each)
        # Of whole hashes: tokens have only 38 bits of theirs.
        content = np.add.reduceat(mix(spoken), np.cumsum(own[live]) - own[live])
        nth = np.arange(len(line)) - np.repeat(new, size)
        keep = nth < np.repeat(size - -(-size * like.percent // 100) + 1, size)
        lines = np.arange(low, high)[live]
        yield {"row": row[lines], "line": place[lines], "size": size, "sig": sig, "content": content, "wide": np.cumsum(words_each) - words_each, "words": wide}, {"of": line[keep], "token": token[keep], "nth": nth[keep]}


def postings(docs: DataFrame, rarity: Rarity, like: Lines, n_parts: int, buckets: int) -> DataFrame:
    def flush(held: list[dict[str, np.ndarray]], posted: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        x = together(held)
        y = {k: np.concatenate([p[k] for p in posted]) for k in posted[0]}
        # Of equal lines among these the first is posted; the others are copies.
        order = np.lexsort((x["line"], x["doc"], x["content"]))
        new = first_of(x["content"][order], x["size"][order], x["sig"][order])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        copy = order[(x["doc"][order] != x["doc"][first]) | (x["line"][order] != x["line"][first])]
        out = [(int(p), COVERED, b) for p, b in lines_to(x["doc"][copy], buckets, doc=x["doc"][copy], line=x["line"][copy])]
        stays = np.ones(len(order), bool)
        stays[copy] = False
        y = {k: v[stays[y["of"]]] for k, v in y.items()}
        part = _part(y["token"], n_parts)
        order = np.argsort(part.view(U64) << U64(TAG_BITS + 8) | y["token"])
        part, token, nth, of = part[order], y["token"][order], y["nth"][order], y["of"][order]
        for i, j in stretches(first_of(part)):
            own = of[i:j]
            out.append((int(part[i]), POSTED, _list({"token": token[i:j], "nth": nth[i:j], **{k: x[k][own] for k in ("doc", "line", "size", "sig", "content", "wide")}, "words": x["words"]})))
        return table_rows(BLOBS, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        posted: list[dict[str, np.ndarray]] = []
        size = n = 0
        for b in slices(batches):
            raw, at = text_bytes(b.column("text"))
            ids, bases = b.column("doc_id").to_numpy(), b.column("base").to_numpy()
            for x, y in prefixes(raw, at, rarity, like):
                row = x.pop("row")
                x["doc"], x["line"], y["of"] = ids[row], x["line"] + bases[row], y["of"] + n
                held.append(x)
                posted.append(y)
                n += len(row)
            size += len(raw)
            if size >= FLUSH and held:
                yield flush(held, posted)
                held, posted, size, n = [], [], 0, 0
        if held:
            yield flush(held, posted)

    return docs.mapInArrow(run, BLOBS)


#: Parts at most: a part's number and a token make one sorting key.
MOST_PARTS = 1 << 18


def _part(token: np.ndarray, n_parts: int) -> np.ndarray:
    return ((mix(token) >> U64(32)) * U64(n_parts) >> U64(32)).astype(np.int64)


POSTING = {"token": np.uint64, "doc": np.int64, "line": np.int64, "size": np.uint32, "nth": np.uint32, "sig": np.uint64, "content": np.uint64}


def together(held: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Lines or postings of several tables in one; `wide` says where each one's signature begins in `words`."""
    x = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
    before = np.cumsum([0, *(len(h["words"]) for h in held[:-1])])
    x["wide"] = np.concatenate([h["wide"] + n for h, n in zip(held, before, strict=True)])
    return x


def take(x: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v if k == "words" else v[which] for k, v in x.items()}


def _list(x: dict[str, np.ndarray]) -> bytes:
    """Postings, by token, in a blob; signatures of more than one word at length."""
    n = width(x["size"])
    own = n > 1
    words = x["words"][ranges(x["wide"][own], n[own])]
    return pack(words=words, **{k: np.diff(x[k], prepend=U64(0)) if k == "token" else x[k].astype(t) for k, t in POSTING.items()})


def lines_to(of: np.ndarray, n_parts: int, **arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Arrays, packed by the buckets of documents."""
    bucket = buckets_of(of, n_parts)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    arrays = {k: v[order] for k, v in arrays.items()}
    for i, j in stretches(first_of(bucket)):
        yield int(bucket[i]), pack(**{k: v[i:j] for k, v in arrays.items()})


def _posted(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    x["token"] = np.cumsum(x["token"])
    x = {k: v if k in ("token", "content", "sig", "words") else v.astype(np.int64) for k, v in x.items()}
    n = width(x["size"]) * (x["size"] > WIDER[0])
    return x | {"wide": np.cumsum(n) - n}


def _alike(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether lines i and j of a list may be similar enough: length, positional and signature filters."""
    m, n = x["size"][i], x["size"][j]
    want = needed(m, n, percent)
    ok = (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & (np.minimum(m - x["nth"][i], n - x["nth"][j]) >= want)
    ok &= np.bitwise_count(x["sig"][i] ^ x["sig"][j]) <= m + n - 2 * want
    long = np.nonzero(ok & (np.minimum(m, n) > WIDER[0]))
    if len(long[0]):
        a, b = np.broadcast_to(i, ok.shape)[long], np.broadcast_to(j, ok.shape)[long]
        m, n = x["size"][a], x["size"][b]
        ok[long] = _differ(x, a, b) <= m + n - 2 * needed(m, n, percent)
    return ok


def _differ(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the signatures of long lines differ, at the width of the narrower one; the other has at most twice as many."""
    out = np.zeros(len(i), np.int64)
    wi, wj = width(x["size"][i]), width(x["size"][j])
    for w in (2, 4, 8, 16):
        for some in np.array_split(np.flatnonzero(np.minimum(wi, wj) == w), max(1, len(i) * w >> 20)):
            if not len(some):
                continue
            sides = []
            for own, its in ((i[some], wi[some]), (j[some], wj[some])):
                at = x["wide"][own][:, None] + np.arange(w)
                side = x["words"][at]
                double = np.flatnonzero(its > w)
                side[double] ^= x["words"][at[double] + w]
                sides.append(side)
            out[some] = np.bitwise_count(sides[0] ^ sides[1]).sum(1, dtype=np.int64)
    return out


PAIR_COLUMNS = ("doc", "line", "to", "at", "more")


def both_sides(x: dict[str, np.ndarray], buckets: int) -> list[tuple[int, int, bytes]]:
    """Pairs for both documents. doc, line: the earlier line; to, at: the later one; more: the token of a list where the later one has more candidates."""
    x = _once(x)
    out = [(p, LATER, b) for p, b in lines_to(x["to"], buckets, **x)]
    new = first_of(*(x[k] for k in PAIR_COLUMNS[:4]))
    x = {k: x[k][new] for k in PAIR_COLUMNS[:4]}
    return out + [(p, EARLIER, b) for p, b in lines_to(x["doc"], buckets, **x)]


def pairs(like: Lines, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate pairs of each part's lists, for `choose` or, in the second round, for both documents; and lists that a second round may need."""

    def send(held: list[dict[str, np.ndarray]], gone: list[np.ndarray], second: bool) -> pa.RecordBatch:
        out = []
        if held:
            x = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            out += both_sides(x, buckets) if second else [(p, FOUND, b) for p, b in lines_to(x["to"], buckets, **x)]
        if gone:
            lines = np.concatenate(gone)
            lines = lines[np.lexsort((lines[:, 1], lines[:, 0]))]
            lines = lines[first_of(lines[:, 0], lines[:, 1])]
            out += [(p, COVERED, b) for p, b in lines_to(lines[:, 0].copy(), buckets, doc=lines[:, 0].copy(), line=lines[:, 1].copy())]
        return table_rows(BLOBS, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        gone: list[np.ndarray] = []
        size, second = 0, False
        for part, rows in grouped(batches):
            posted: list[dict[str, np.ndarray]] = []
            asking: list[dict[str, np.ndarray]] = []
            for r in rows:
                x = unpack(r["blob"])
                if r["kind"] == COVERED:
                    gone.append(np.column_stack([x["doc"], x["line"]]))
                    size += len(x["doc"])
                elif r["kind"] == ASKING:
                    asking.append(x)
                else:
                    second |= r["kind"] == LIST
                    posted.append(_posted(x))
            if not posted:
                continue
            x = together(posted)
            posted.clear()
            if second:
                found = _rest(x, asking, like.percent)
            else:
                x, copies = _without_copies(x)
                gone.append(copies)
                size += len(copies)
                found = [_first(x, like.percent)]
                _, j, more = found[0]
                if more.any():
                    group = np.cumsum(first_of(x["token"])) - 1
                    keep = np.zeros(int(group[-1]) + 1, bool)
                    keep[group[j[more > 0]]] = True
                    yield table_rows(BLOBS, [(part, LIST, _list(take(x, keep[group])))])
            for i, j, more in found:
                held.append({"doc": x["doc"][i], "line": x["line"][i], "to": x["doc"][j], "at": x["line"][j], "more": more} | ({} if second else {"list": x["token"][j].astype(np.int64)}))
                size += len(i)
                if size >= SENT:
                    yield send(held, gone, second)
                    held, gone, size = [], [], 0
        if held or gone:
            yield send(held, gone, second)

    return run


def choose(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each later line the pair that most lists give (of equals, the earliest line), with the lists that have more candidates; and its other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            held = [unpack(r["blob"]) for r in rows]
            x = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            order = np.lexsort((x["line"], x["doc"], x["at"], x["to"]))
            x = {k: v[order] for k, v in x.items()}
            later = np.cumsum(first_of(x["to"], x["at"])) - 1
            new = first_of(x["to"], x["at"], x["doc"], x["line"])
            lists = np.diff(np.append(np.flatnonzero(new), len(new)))
            heads = np.flatnonzero(new)
            order = np.lexsort((np.arange(len(heads)), -lists, later[heads]))
            best = heads[order[first_of(later[heads][order])]][later]  # for each row the first one of its line's chosen pair
            out = both_sides({k: x[k][best] for k in PAIR_COLUMNS[:4]} | {"more": np.where(x["more"] > 0, x["list"], NONE)}, buckets)
            other = new & ((x["doc"] != x["doc"][best]) | (x["line"] != x["line"][best]))
            yield table_rows(BLOBS, out + [(p, OTHER, b) for p, b in lines_to(x["to"][other], buckets, **{k: x[k][other] for k in PAIR_COLUMNS[:4]})])

    return run


def _once(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Pairs sorted by earlier and later line, each once for each list that has more, or once."""
    order = np.lexsort(tuple(x[k] for k in PAIR_COLUMNS[::-1]))
    order = order[first_of(*(x[k][order] for k in PAIR_COLUMNS))]
    x = {k: v[order] for k, v in x.items()}
    # NONE is the least, so such a row comes first of its pair's; it counts if it is the last, too.
    last = np.ones(len(order), bool)
    last[:-1] = first_of(*(x[k] for k in PAIR_COLUMNS[:4]))[1:]
    keep = (x["more"] != NONE) | last
    return {k: v[keep] for k, v in x.items()}


def _without_copies(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Lists of more than one line, with the first of equal lines only, by token, document and line; and the other lines: (doc, line) rows."""
    order = np.argsort(x["token"])
    new = first_of(x["token"][order])
    size = np.diff(np.append(np.flatnonzero(new), len(new)))
    order = order[np.repeat(size > 1, size)]  # the rest meets nobody
    order = order[np.lexsort((x["line"][order], x["doc"][order], x["token"][order]))]
    x = take(x, order)
    order = np.argsort(mix(x["token"] ^ x["content"]), kind="stable")  # equal lines of a list, the first one first
    new = first_of(*(x[k][order] for k in ("token", "content", "sig", "size")))
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(new) else order
    copy = order[(x["doc"][order] != x["doc"][first]) | (x["line"][order] != x["line"][first])]
    gone = np.column_stack([x["doc"][copy], x["line"][copy]])
    keep = np.ones(len(order), bool)
    keep[copy] = False
    return take(x, keep), gone


def _first(x: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line of each list its first candidate: earlier line, line, and whether the list holds more of them.

    Lines are held against the list's members from the first on, until they have two candidates: short lists all at
    once, long ones some hundred members at a time.
    """
    new = first_of(x["token"])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(new)))
    place = np.arange(len(new)) - np.repeat(begin, length)
    count, one = np.zeros(len(new), np.int8), np.zeros(len(new), np.int64)
    other = lambda i, j: (x["doc"][i] != x["doc"][j]) | (x["line"][i] != x["line"][j])
    j = np.flatnonzero((place > 0) & (np.repeat(length, length) <= SHORT))
    for hub in range(SHORT):
        j = j[place[j] > hub]
        if not len(j):
            break
        i = j - place[j] + hub
        ok = _alike(x, i, j, percent) & other(i, j)
        fresh = ok & (count[j] == 0)
        one[j[fresh]] = i[fresh]
        count[j[ok]] += 1
        j = j[count[j] < 2]
    for k in np.flatnonzero(length > SHORT).tolist():
        a, b = int(begin[k]), int(begin[k] + length[k])
        rest = np.arange(a + 1, b)
        for low in range(a, b, HUBS):
            rest = rest[(rest > low) & (count[rest] < 2)]
            if not len(rest):
                break
            for at in range(0, len(rest), BLOCK // HUBS):
                j = rest[at : at + BLOCK // HUBS, None]
                i = np.arange(low, min(low + HUBS, b))[None, :]
                ok = _alike(x, i, j, percent) & (i < j) & other(i, j)
                own, some = j[:, 0], ok.any(1)
                fresh = some & (count[own] == 0)
                one[own[fresh]] = low + np.argmax(ok[fresh], axis=1)
                count[own] += np.minimum(ok.sum(1), 2).astype(np.int8)
    j = np.flatnonzero(count)
    return one[j], j, (count[j] > 1).astype(np.int64)


def _rest(x: dict[str, np.ndarray], asking: list[dict[str, np.ndarray]], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each line that asks (token, document, line) all its candidates in that list, some at a time."""
    if not asking:
        return
    y = {k: np.concatenate([a[k] for a in asking]) for k in asking[0]}
    begin = np.flatnonzero(first_of(x["token"]))
    end = np.append(begin[1:], len(x["token"]))
    for token, doc, line in zip(*(y[k].tolist() for k in ("token", "doc", "line")), strict=True):
        k = int(np.searchsorted(x["token"][begin], U64(token)))
        i, j = int(begin[k]), int(end[k])
        low, high = i + np.searchsorted(x["doc"][i:j], [doc, doc + 1])
        me = low + int(np.searchsorted(x["line"][low:high], line))
        for step in range(i, me, BLOCK):
            earlier = np.arange(step, min(me, step + BLOCK))
            earlier = earlier[_alike(x, earlier, np.array([me]), percent)]
            if len(earlier):
                yield earlier, np.full(len(earlier), me), np.full(len(earlier), NONE)


def _line_sets(text: bytes, lines: np.ndarray) -> list[np.ndarray]:
    """Token sets of some lines of a text."""
    raw = np.frombuffer(text, np.uint8)
    words, _, place, n = line_words(raw, np.array([0, len(raw)]))
    end = np.cumsum(n)
    return [np.unique(words[end[i] - n[i] : end[i]]) for i in np.searchsorted(place, lines).tolist()]


def _documents(batches: Iterator[pa.RecordBatch], kinds: dict[int, tuple[str, str]]) -> Iterator[tuple[dict, dict[int, dict[str, np.ndarray]]]]:
    """Each text with its rows of each kind, sorted by document and line; kinds: the columns with these two."""
    for _, rows in grouped(batches):
        held: dict[int, list[dict[str, np.ndarray]]] = {k: [] for k in kinds}
        ready: dict[int, dict[str, np.ndarray]] | None = None
        for r in rows:
            if r["kind"] != TEXT:
                held[r["kind"]].append(unpack(r["blob"]))
                continue
            if ready is None:
                ready = {}
                for k, blobs in held.items():
                    if blobs:
                        x = {c: np.concatenate([b[c] for b in blobs]) for c in blobs[0]}
                        order = np.lexsort((x[kinds[k][1]], x[kinds[k][0]]))
                        ready[k] = {c: v[order] for c, v in x.items()}
            own = {}
            for k, x in ready.items():
                doc, line = kinds[k]
                i, j = np.searchsorted(x[doc], [r["doc_id"], r["doc_id"] + 1])
                if i < j:  # of this text among those of its id
                    i, j = i + np.searchsorted(x[line][i:j], [r["base"], r["base"] + len(r["blob"]) + 1])
                if i < j:
                    own[k] = {c: v[i:j] for c, v in x.items()}
            yield r, own


def send_sets(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Token sets of the lines of pairs, and the pairs, to the later line's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {k: [] for k in ("to", "doc", "line")}
        sets: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            to, doc, line = (np.concatenate(held[k]) for k in ("to", "doc", "line"))
            n = np.array([len(t) for t in sets], np.int64)
            tokens = np.concatenate(sets)
            at = np.cumsum(n) - n
            ref = np.concatenate([np.full(len(t), k) for k, t in enumerate(held["to"])])
            bucket = buckets_of(to, buckets)
            order = np.lexsort((line, doc, bucket))
            out = []
            for i, j in stretches(first_of(bucket[order])):
                own = order[i:j]
                own = own[first_of(doc[own], line[own])]  # a set goes to a bucket once
                m = n[ref[own]]
                out.append((int(bucket[order[i]]), SET, pack(doc=doc[own], line=line[own], size=m, t=tokens[ranges(at[ref[own]], m)])))
            return table_rows(BLOBS, out)

        done: set[tuple[int, int]] = set()
        for row, own in _documents(batches, {EARLIER: ("doc", "line"), LATER: ("to", "at")}):
            name = (row["doc_id"], row["base"])
            if not own or name in done:
                continue
            done.add(name)
            lines = np.concatenate([own[EARLIER]["line"] if EARLIER in own else NO_LINES, own[LATER]["at"] if LATER in own else NO_LINES])
            to = np.concatenate([own[EARLIER]["to"] if EARLIER in own else NO_LINES, own[LATER]["to"] if LATER in own else NO_LINES])
            order = np.argsort(lines, kind="stable")
            lines, to = lines[order], to[order]
            heads = first_of(lines)
            for tokens, (i, j) in zip(_line_sets(row["blob"], lines[heads] - row["base"]), stretches(heads), strict=True):
                sets.append(tokens)
                target = np.unique(to[i:j])
                held["to"].append(target)
                held["doc"].append(np.full(len(target), row["doc_id"]))
                held["line"].append(np.full(len(target), lines[i]))
                size += len(tokens) + len(target)
            if size > SENT:
                yield flush()
                held, sets, size = {k: [] for k in held}, [], 0
        if sets:
            yield flush()

    return run


NO_LINES = np.zeros(0, np.int64)


def compare(like: Lines, n_parts: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines that are similar to an earlier one; and of those that must look further the other pairs, and the lists that have more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            found: list[dict[str, np.ndarray]] = []
            named: list[dict[str, np.ndarray]] = []
            others: list[dict[str, np.ndarray]] = []
            for r in rows:
                {LATER: found, SET: named, OTHER: others}[r["kind"]].append(unpack(r["blob"]))
            if not found:
                continue
            x = _once({k: np.concatenate([f[k] for f in found]) for k in PAIR_COLUMNS})
            doc, line, size = (np.concatenate([s[k] for s in named]) for k in ("doc", "line", "size"))
            tokens = np.concatenate([s["t"] for s in named])
            at = np.cumsum(size) - size
            order = np.lexsort((line, doc))
            order = order[first_of(doc[order], line[order])]
            i, j = _place(doc[order], line[order], x["doc"], x["line"]), _place(doc[order], line[order], x["to"], x["at"])
            i, j = order[i], order[j]
            alike = np.zeros(len(i), bool)
            for low in range(0, len(i), COMPARED):
                a, b = i[low : low + COMPARED], j[low : low + COMPARED]
                pair = np.repeat(np.arange(len(a), dtype=np.int64), size[a] + size[b])
                both = np.concatenate([np.stack([at[a], at[b]], 1).ravel(), np.stack([size[a], size[b]], 1).ravel()]).reshape(2, -1)
                every = tokens[ranges(both[0], both[1])]
                k = np.lexsort((every, pair))
                twice = np.flatnonzero((every[k][1:] == every[k][:-1]) & (pair[k][1:] == pair[k][:-1]))
                shared = np.bincount(pair[k][twice], minlength=len(a))
                alike[low : low + COMPARED] = 100 * shared >= like.percent * (size[a] + size[b] - shared)
            order = np.lexsort((x["at"], x["to"]))
            heads = first_of(x["to"][order], x["at"][order])
            group = np.cumsum(heads) - 1
            gone = np.zeros(int(heads.sum()), bool)
            gone[group[alike[order]]] = True
            to, place = x["to"][order][heads][gone], x["at"][order][heads][gone]
            out = [(p, COVERED, b) for p, b in lines_to(to, buckets, doc=to, line=place)]
            asks = order[~gone[group] & (x["more"][order] != NONE)]
            token = x["more"][asks].view(U64)
            part = _part(token, n_parts)
            k = np.lexsort((x["at"][asks], x["to"][asks], token, part))
            asks, token, part = asks[k], token[k], part[k]
            once = first_of(token, x["to"][asks], x["at"][asks]) if len(asks) else np.zeros(0, bool)
            asks, token, part = asks[once], token[once], part[once]
            out += [(int(part[a]), ASKING, pack(token=token[a:b], doc=x["to"][asks[a:b]], line=x["at"][asks[a:b]])) for a, b in stretches(first_of(part))]
            if others and not gone.all():
                y = {k: np.concatenate([o[k] for o in others]) for k in PAIR_COLUMNS[:4]}
                order = np.lexsort((x["at"], x["to"]))[heads]  # each later line once
                fails = ~gone[_place(x["to"][order], x["at"][order], y["to"], y["at"])]
                if fails.any():
                    out += both_sides({k: v[fails] for k, v in y.items()} | {"more": np.full(int(fails.sum()), NONE)}, buckets)
            yield table_rows(BLOBS, out)

    return run


#: Pairs whose sets are compared at once.
COMPARED = 4_096


def _place(doc: np.ndarray, line: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where lines are among lines sorted by document and line; all are there."""
    n = len(doc)
    order = np.lexsort((np.arange(n + len(of)) >= n, np.concatenate([line, at]), np.concatenate([doc, of])))
    known = order < n
    out = np.empty(n + len(of), np.int64)
    out[order] = np.cumsum(known) - 1
    return out[n:]


def _named(rows: DataFrame) -> DataFrame:
    """Documents that pairs speak of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(0, np.int64)
        for b in batches:
            own = [unpack(blob.as_py())["doc" if kind == EARLIER else "to"] for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob"), strict=True)]
            found = np.unique(np.concatenate([found, *own]))
        yield pa.record_batch([pa.array(found)], names=["doc_id"])

    return rows.mapInArrow(run, "doc_id long").distinct()


def removed_lines(docs: DataFrame, like: Lines, scratch: Scratch, n_parts: int, buckets: int, n: int) -> DataFrame:
    """Rows of kind COVERED: the removed lines, in their documents' buckets."""
    rarity = count_tokens(docs, scratch)

    def verify(asked: DataFrame, name: str) -> DataFrame:
        """Compared pairs of kinds EARLIER, LATER and OTHER: removed lines, further pairs and lists."""
        of_pairs = with_ids(docs, scratch.save(_named(asked.where(F.col("kind") != OTHER)), f"{name}-named"))
        sets = meet(asked.where(F.col("kind") != OTHER), of_pairs, buckets, n).mapInArrow(send_sets(buckets), BLOBS)
        rows = sets.unionByName(asked.where(F.col("kind") != EARLIER))
        return scratch.save(by_part(rows, n).mapInArrow(compare(like, n_parts, buckets), BLOBS), f"{name}-verified")

    def listed(rows: DataFrame, name: str) -> DataFrame:
        return scratch.save(by_part(rows, n).mapInArrow(pairs(like, buckets), BLOBS), f"{name}-pairs")

    found = listed(postings(docs, rarity, like, n_parts, buckets), "first")
    chosen = scratch.save(by_part(found.where(F.col("kind") == FOUND), n).mapInArrow(choose(buckets), BLOBS), "chosen")
    compared = verify(chosen, "first")
    gone = compared.unionByName(found).where(F.col("kind") == COVERED)
    further = compared.where(F.col("kind") != COVERED)
    if further.limit(1).count():
        asking = further.where(F.col("kind") == ASKING)
        lists = found.where(F.col("kind") == LIST).join(asking.select("part").distinct(), "part", "left_semi")
        rest = listed(lists.unionByName(asking), "second").unionByName(further.where(F.col("kind") != ASKING))
        gone = gone.unionByName(verify(rest, "second").where(F.col("kind") == COVERED))
    return gone


def _settled(docs: DataFrame, like: Lines, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """Removed lines of documents (doc_id, text, base), the number of buckets and of partitions."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * n
    return removed_lines(docs, like, scratch, min(MOST_PARTS, parts(docs, 4 << 20, least=n)), buckets, n), buckets, n


def _rest_of(text: bytes, lines_gone: np.ndarray) -> tuple[int, int, bytes]:
    """Lines, removed lines, and the text without them."""
    lines = text.split(b"\n") if text else []
    keep = np.ones(len(lines), bool)
    keep[lines_gone] = False
    return len(lines), int((~keep).sum()), b"\n".join([x for x, k in zip(lines, keep.tolist(), strict=True) if k])


def _touched(gone: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents that lose a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [unpack(blob.as_py())["doc"] for blob in b.column("blob")]
            if found:
                yield pa.record_batch([pa.array(np.unique(np.concatenate(found)))], names=["doc_id"])

    return scratch.save(gone.select("blob").mapInArrow(run, "doc_id long").distinct(), "touched")


def dedup_lines(docs: DataFrame, like: Lines | None = None) -> DataFrame:
    """Lines removed from every document; see the module. Documents that lose none take no part in the last shuffle."""
    scratch = Scratch(docs.sparkSession, "lines")
    docs, _ = with_bases(documents(docs), scratch)
    gone, buckets, n = _settled(docs, like or Lines(), scratch)
    touched = _touched(gone, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row, own in _documents(batches, {COVERED: ("doc", "line")}):
            lines, removed, rest = _rest_of(row["blob"], own[COVERED]["line"] - row["base"] if COVERED in own else NO_LINES)
            out.append((row["doc_id"], lines, removed, hashlib.sha256(rest).hexdigest()))
            if len(out) >= 512:
                yield table_rows(SCHEMA, out)
                out = []
        if out:
            yield table_rows(SCHEMA, out)

    text = F.coalesce("text", F.lit(""))
    n_lines = F.when(text == "", 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    whole = with_ids(docs, touched, "left_anti").select("doc_id", n_lines.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    return whole.unionByName(meet(gone, with_ids(docs, touched), buckets, n).mapInArrow(run, SCHEMA))


def without_repeated_lines(docs: DataFrame, like: Lines | None = None) -> DataFrame:
    """The documents without removed lines, null texts as they are; other columns stay, n_chars follows the text where it changes."""
    scratch = Scratch(docs.sparkSession, "lines")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(others)), F.lit(0).alias("none"))
    whole = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    light, _ = with_bases(documents(docs), scratch)
    gone, buckets, n = _settled(light, like or Lines(), scratch)
    touched = _touched(gone, scratch)
    some, _ = with_bases(with_ids(whole, touched), scratch)

    schema = StructType([*StructType.fromDDL("doc_id long, text string").fields, whole.schema["rest"], *StructType.fromDDL("removed boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[str | None] = []
        removed: list[bool] = []
        kept: list[pa.Scalar] = []
        held = 0

        def send() -> pa.RecordBatch:
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array([k.as_py() for k in kept], kept[0].type), pa.array(removed, pa.bool_())], names=["doc_id", "text", "rest", "removed"])

        for row, own in _documents(batches, {COVERED: ("doc", "line")}):
            n_gone, left = 0, row["blob"]
            if COVERED in own:
                _, n_gone, left = _rest_of(row["blob"], own[COVERED]["line"] - row["base"])
                if not left.strip():
                    continue
            ids.append(row["doc_id"])
            texts.append(left.decode())
            removed.append(n_gone > 0)
            kept.append(row["rest"])
            held += len(left)
            if len(ids) >= 512 or held > 4 << 20:
                yield send()
                ids, texts, removed, kept, held = [], [], [], [], 0
        if ids:
            yield send()

    # A null text has no lines: its row stays as it is, whatever other texts its id has.
    found = meet(gone, some.where("text is not null"), buckets, n).mapInArrow(run, schema)
    alone = with_ids(whole, touched, "left_anti").unionByName(with_ids(whole, touched).where("text is null")).withColumn("removed", F.lit(False))
    column = {c: F.col("rest")[f"c{i}"] for i, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in others:
        column["n_chars"] = F.when(F.col("removed"), F.char_length("text")).otherwise(column["n_chars"]).cast("long")
    return alone.unionByName(found).select(*(column[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
