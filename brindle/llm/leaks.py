"""Passages of evaluation texts in a corpus.

Texts are compared as streams of letters and digits, so that layout, punctuation and marks inside words play no part. A
stretch of ``min_words`` words with at most ``max_edits`` wrong characters holds, by the pigeonhole principle, at least
one whole piece intact if the item is cut into pieces so short that any such stretch covers budget-plus-one of them. The
pieces are found exactly by one automaton pass, and each hit is verified by Myers' bit-parallel edit distance. Where words
must be equal, that comes last.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import cached_property, reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
#: Items are searched for in blocks whose texts have at most so many characters together; a block is what is broadcast.
BLOCK_CHARS = 8_000_000
#: So many characters beside a piece are compared at once, after so few.
LANE, SHORT_LANE = 40, 8


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


_PAD = np.zeros(LANE, np.uint32)


class Stream:
    """The words of a text as one string of letters and digits, with the offsets at which they begin and end."""

    def __init__(self, words: list[str]):
        self.words, self.text = words, "".join(words)

    @cached_property
    def ends(self) -> list[int]:
        return list(accumulate(map(len, self.words)))

    @cached_property
    def starts(self) -> list[int]:
        return [0, *self.ends[:-1]] if self.words else []


def words_of(text: str | None) -> list[str]:
    """Words of letters and digits, NFKC and case folded; all else separates them, but characters of no width do not."""
    import regex

    global _WORD, _NO_WIDTH
    try:
        find, drop = _WORD, _NO_WIDTH
    except NameError:
        find = _WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall
        drop = _NO_WIDTH = regex.compile(r"[\p{Cf}̀-ͯ]+").sub
    if not text:
        return []
    if not text.isascii():
        text = drop("", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()))
    else:
        text = text.casefold()
    return find(text)


def myers(pattern: str, text: str, most: int | None = None) -> int:
    """The least edit distance of pattern to any stretch of text, by Myers' bit vectors.

    With ``most`` given, a number above it only says that the distance is above it: the search ends where it must be.
    """
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    # Each character of the text lowers the score by one at most.
    bound = m + len(text) if most is None else most + len(text)
    for ch in text:
        if score > bound and best > most:
            break
        bound -= 1
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        best = min(best, score)
    return best


def near_lanes(patterns: np.ndarray, lengths: np.ndarray, texts: np.ndarray, most: int) -> np.ndarray:
    """Which patterns are within ``most`` edits of a beginning of their text: Myers' bit vectors, one of 64 bits a lane.

    A row of patterns (at most 63 characters, of which the first ``lengths`` count) and of texts is a lane; 0 equals nothing.
    """
    n, one = len(patterns), np.uint64(1)
    places = np.arange(patterns.shape[1]) < lengths[:, None]
    weight = one << np.arange(patterns.shape[1], dtype=np.uint64)
    pv, mv = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    top = (lengths - 1).astype(np.uint64)
    score, near = lengths.astype(np.int64), lengths <= most
    for j in range(texts.shape[1]):
        eq = ((patterns == texts[:, j, None]) & places & (texts[:, j, None] != 0)) @ weight
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
        ph, mh = (ph << one) | one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
        near |= score <= most
    return near


class Finder:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS, max_edits: int = 0, exact: bool = True):
        import ahocorasick

        if min_words < max_edits + 1:
            raise ValueError("min_words must exceed max_edits")
        self.n, self.k, self.exact = min_words, max_edits, exact
        # Any min_words words cover max_edits + 1 whole pieces of this many words that follow one another in an item.
        self.piece = max(1, (min_words + 1) // (max_edits + 2))
        # Of the words beside a piece, a stretch that holds it has so many before it or so many behind it.
        self.beside = (min_words - self.piece) // 2
        self.items = [(i, Stream(words_of(t))) for i, t in items]
        self.auto = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int, int, int, int, int]]] = {}
        chars, base = [_PAD], LANE
        for x, (_, s) in enumerate(self.items):
            for w in range(0, len(s.starts) - self.piece + 1, self.piece) if len(s.starts) >= self.n else ():
                lo, hi = s.starts[w], s.ends[w + self.piece - 1]
                left = lo - s.starts[w - self.beside] if w >= self.beside else -1
                right = s.ends[w + self.piece - 1 + self.beside] - hi if w + self.piece + self.beside <= len(s.starts) else -1
                at.setdefault(s.text[lo:hi], []).append((x, w, base + lo, base + hi, min(left, LANE), min(right, LANE)))
            chars += [_codes(s.text), _PAD]
            base += len(s.text) + LANE
        self.chars = np.concatenate(chars)
        for no, piece in enumerate(at):
            self.auto.add_word(piece, no)
        self.many = np.array([len(v) for v in at.values()], np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.sizes = np.array([len(p) for p in at], np.int64)
        self.places = np.array([x for v in at.values() for x in v], np.int64).reshape(-1, 6)
        self.empty = not at
        if not self.empty:
            self.auto.make_automaton()

    def _distance(self, s: Stream, w: int, doc: str, at: int) -> int:
        """An edit distance, or budget plus one, of a stretch of min_words words of the item around piece w, which stands at ``at``.

        It is the least of any stretch unless words must be equal, as then one within the budget will do.
        """
        first, last = max(0, w + self.piece - self.n), min(w, len(s.starts) - self.n)
        best = self.k + 1
        for a in range(first, last + 1):
            left, right = s.starts[w] - s.starts[a], s.ends[a + self.n - 1] - s.starts[w]
            if at - left < -self.k or at + right > len(doc) + self.k:
                continue
            stretch = doc[max(0, at - left - self.k) : at + right + self.k]
            best = min(best, myers(s.text[s.starts[a] : s.ends[a + self.n - 1]], stretch, self.k))
            if not best or (self.exact and best <= self.k):
                break
        return best

    def _run(self, s: Stream, w: int, doc: Stream, at: int) -> tuple[int, int, int]:
        """The exact common stretch around the hit: words of the item it holds whole, and its offsets in the document."""
        a, i, j = s.text, s.starts[w], at
        lo = 0
        while i - lo > 0 and j - lo > 0 and a[i - lo - 1] == doc.text[j - lo - 1]:
            lo += 1
        hi, most = 0, min(len(a) - i, len(doc.text) - j)
        while hi < most and a[i + hi] == doc.text[j + hi]:
            hi += 1
        first, last = bisect_left(s.starts, i - lo), bisect_right(s.ends, i + hi) - 1
        shift = j - i
        # Both ends must be ends of words in the document, too.
        while first <= last and not _has(doc.starts, s.starts[first] + shift):
            first += 1
        while last >= first and not _has(doc.ends, s.ends[last] + shift):
            last -= 1
        return last - first + 1, j - lo, j + hi

    def _verified(self, docs: list[Stream], hits: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, word, offset) of the hits beside which, on one side, the item's words are within the budget."""
        base = np.cumsum([LANE] + [len(d.text) + LANE for d in docs])[:-1]
        chars = np.concatenate([_PAD] + [c for d in docs for c in (_codes(d.text), _PAD)])
        span = np.arange(LANE + self.k)
        for i in range(0, len(hits), 50_000):
            doc, end, piece = np.array(hits[i : i + 50_000], np.int64).T
            many = self.many[piece]
            row = np.repeat(np.arange(len(doc)), many)
            place = np.repeat(self.first[piece] - np.cumsum(many) + many, many) + np.arange(len(row))
            x, w, lo, hi, left, right = self.places[place].T
            stop = (end + 1)[row]
            start = stop - self.sizes[piece][row]
            ok = np.zeros(len(row), bool)
            for length, own, theirs, step in ((right, hi, base[doc][row] + stop, 1), (left, lo - 1, base[doc][row] + start - 1, -1)):
                at = np.flatnonzero((length >= 0) & ~ok)
                for lane in (SHORT_LANE, LANE):  # few hits outlive a short beginning
                    # Texts end in zeros, but a lane may reach into the next one: that only lets more through.
                    text = chars[np.clip(theirs[at, None] + step * span[: lane + self.k], 0, len(chars) - 1)]
                    word = self.chars[np.clip(own[at, None] + step * span[:lane], 0, len(self.chars) - 1)]
                    at = at[near_lanes(word, np.minimum(length[at], lane), text, self.k)]
                ok[at] = True
            yield from zip(doc[row[ok]].tolist(), x[ok].tolist(), w[ok].tolist(), start[ok].tolist())

    def _settle(self, docs: list[Stream], hits: list[tuple[int, int, int]]) -> list[dict[int, int]]:
        found: list[dict[int, int]] = [{} for _ in docs]
        tried: dict[tuple[int, int, int], int] = {}
        for d, x, w, at in self._verified(docs, hits) if hits else ():
            item, s = self.items[x]
            if not found[d].get(item, 1):
                continue
            # Hits of one stretch: those of its later pieces tell nothing new.
            shift = (d, x, at - s.starts[w])
            if tried.get(shift, -1) >= at + s.ends[w + self.piece - 1] - s.starts[w]:
                continue
            edits = self._distance(s, w, docs[d].text, at)
            if edits > self.k:
                continue
            if self.exact:
                words, _, upto = self._run(s, w, docs[d], at)
                tried[shift] = upto
                if words < self.n:
                    continue
                edits = 0
            found[d][item] = min(edits, found[d].get(item, edits))
        return found

    def find(self, texts: Iterable[str | None]) -> Iterator[dict[int, int]]:
        """For each text the items of which it holds a stretch of min_words words, with the least edit distance of any.

        A hit of a piece counts if Myers' distance is within the budget and, if exact, the words around it are equal.
        """
        docs: list[Stream] = []
        hits: list[tuple[int, int, int]] = []
        size = 0
        for text in texts:
            doc = Stream(words_of(text))
            if not self.empty and doc.text:
                hits += [(len(docs), end, piece) for end, piece in self.auto.iter(doc.text)]
            docs.append(doc)
            size += len(doc.text)
            if size > 2_000_000 or len(hits) > 200_000:
                yield from self._settle(docs, hits)
                docs, hits, size = [], [], 0
        yield from self._settle(docs, hits)


def _has(sorted_list: list[int], x: int) -> bool:
    i = bisect_left(sorted_list, x)
    return i < len(sorted_list) and sorted_list[i] == x


def leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_edits: int = 0, exact: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits): documents that hold at least ``min_words`` consecutive words of an item.

    docs: doc_id, text; items: item_id, text; other columns are ignored. With ``exact`` every word must be equal after
    normalisation, so edits is 0; without it up to ``max_edits`` characters of a stretch may be wrong, missing or too many,
    and edits is the least number of any stretch. Null, empty and short texts hold nothing and an item of fewer words leaks
    nowhere. Repeated documents and items give one row each pair. Empty tables give no rows. Items are a stated query set:
    they are gathered in blocks of at most ``block_chars`` characters, each of which is broadcast and searched for in every
    document, so that any number of items can be given.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    fields = "doc_id bigint, item_id bigint, edits int"

    def search(block: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            finder = Finder(sent.value, min_words, max_edits, exact)
            for b in batches:
                hits = [(d, i, e) for d, t in zip(b["doc_id"], finder.find(b["text"])) for i, e in t.items()]
                cols = list(zip(*hits)) if hits else [(), (), ()]
                yield pd.DataFrame({"doc_id": np.array(cols[0], np.int64), "item_id": np.array(cols[1], np.int64), "edits": np.array(cols[2], np.int32)})

        return rows.mapInPandas(run, fields)

    parts: list[DataFrame] = []
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null and text is not null").toLocalIterator():
        if block and size + len(r["text"]) > block_chars:
            parts.append(search(block))
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    parts.append(search(block))
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
