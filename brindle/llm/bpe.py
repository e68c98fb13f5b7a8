"""Token ids of texts by a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern. A short word is merged in a contiguous array of part boundaries
with the rank of each adjacent pair beside it: the least rank is found by a scan, its inner boundary is deleted and the
ranks at its two neighbours are looked up again. A long word, where scanning would be quadratic, keeps the same pairs in
a heap. Words repeat, so each worker remembers those it has merged.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts texts into words, with White_Space spelled out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHORT = 200
REMEMBERED = 400_000
NONE = 1 << 60


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line for each token, base64 and rank."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    get = ranks.get
    bounds = list(range(len(word) + 1))
    pair = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while pair:
        least = min(pair)
        if least == NONE:
            break
        i = pair.index(least)
        del bounds[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(word[bounds[i] : bounds[i + 2]], NONE)
        if i:
            pair[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks = ranks
        self.words = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def word(self, w: str) -> list[int]:
        raw = w.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else (merge_short if len(raw) <= SHORT else merge_long)(raw, self.ranks)
        if len(raw) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[w] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            known, word = self.known.get, self.word
            for w in self.words(text):
                out += known(w) or word(w)
        return out


def encode_corpus(docs: DataFrame, text: str = "text", into: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with the column ``into``: the ids of ``text`` by the vocabulary file, without special tokens.

    Null and empty texts have the empty list; the strings of special tokens are ordinary text; texts of any length are
    encoded whole; repeated rows are each encoded; an empty table stays empty; a column already named ``into`` is replaced.
    The vocabulary is read on the driver and broadcast: its size is that of the file, whatever the corpus.
    """
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(read_ranks(raw.value))
        for s in texts:
            yield pd.Series([encoder.encode(t) for t in s], index=s.index, dtype=object)

    return docs.withColumn(into, ids(F.col(text)))
