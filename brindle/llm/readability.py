"""The reading level of documents, learned from graded samples.

Running English is taken out of a text (code, symbol names and marks left out) and described by a few features of its
sentences and its vocabulary. A linear ranker is learned from all pairs of samples of different grades; isotonic
regression turns its scores into levels.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 40
#: The model is fitted on at most so many samples, those of the least ids.
MAX_SAMPLES = 5_000

#: Frequent function words, the frame of running English.
ENGLISH = frozenset(
    "a about after again all although an and any are as at be because been before but by can cannot could did do does each for from had has have he how i if in into is it its may "
    "more most must no not of on once one only or other our out over put should since so some such than that the their them then there these they this those through to two up upon us "
    "very was we were what when where whether which while who will with without would you your yet need look nor neither whose rather every people".split()
)
#: A paragraph with a smaller share of them is no English prose; one with a larger share than the second is; the letters of others decide.
FEW, MANY = 0.13, 0.4

_FENCE = re.compile(r"(?:^|\n)[ \t]*(```|~~~)[^\n]*\n.*?(?:\n[ \t]*\1[^\n]*(?=\n|$)|\Z)", re.S)
_ASIDE = re.compile(r"[,;]?\s*(?:\(?\s*(?:e\.g\.|i\.e\.|cf\.|see)\s*)?`[^`\n]{1,200}`\s*\)?")
_CITED = re.compile(r",?\s*\(?\s*(?:e\.g\.|cf\.)\s+[\w./:-]+\s*\)?|\s+since v?\d+(?:\.\d+)+")
_MAY_CITE = re.compile(r"e\.g\.|cf\.|since")
_SYMBOL = re.compile(r"::|\w\(\)|[A-Za-z0-9]_[A-Za-z0-9]|[A-Za-z]{2,}[./][A-Za-z]{2,}|https?://")
_INNER_DOT = re.compile(r"[A-Za-z]\.[A-Za-z]")
_MAY_BE_SYMBOL = re.compile(r"[:(_./]")
_MARKS = re.compile(r"[*_~\"“”„«»()\[\]<>|]+")
_BULLET = re.compile(r"^\s*(?:[-*+•>]+|\d+[.)])\s+")
_KEYWORD = r"(?:import|from|def|class|func|fn|function|return|public|private|static|export|const|let|var|package|use|assert|raise|throw|for|if|elif|else|while|try|except|catch|finally|with|switch|case|await|break|continue|pass|end)\b"
_CODE_LINE = re.compile(
    r"[;{}]\s*$|^\s*(?:#(?!\s)|//|/\*|\*/|\*\s|--\s|@\w|#include)|\w\s*(?:[-+|*/]?=|=>|->|:=|&&|\|\||!=)\s*\S|\w\([^)]*\)\s*[:{?]?\s*$"
    rf"|^\s*{_KEYWORD}(?:[^.!?]*[=(){{}};&<>\[\]][^.!?]*|[^.!?,]*:\s*$|(?:\s+[\w.\"']+){{0,2}}\s*$)|\bis (?:not )?None\b"
)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"[A-Za-zÀ-ÿ]+(?:['’][A-Za-z]+)?")
_VOWELS = re.compile(r"[aeiouy]+")


class _Seen(dict):
    """Characters without those of no width and controls, each looked up once."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = code if c in "\n\t" or unicodedata.category(c) not in ("Cc", "Cf", "Mn") else None
        return self[code]


_SEEN = _Seen()


def paragraphs(text: str | None) -> list[list[str]]:
    """Paragraphs of sentences of prose: code, headings, symbol names and marks are left out."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n").replace("\x85", "\n").replace(" ", "\n").replace(" ", "\n\n")
    text = text if text.isascii() else text.translate(_SEEN)
    text = _FENCE.sub("\n\n", text)
    out: list[list[str]] = []
    block: list[str] = []

    def close() -> None:
        if block:
            prose = " ".join(block)
            if "_" in prose or "/" in prose or "::" in prose or "()" in prose or _INNER_DOT.search(prose):
                prose = " ".join(w for w in prose.split() if not (_MAY_BE_SYMBOL.search(w) and _SYMBOL.search(w)))
            prose = _MARKS.sub(" ", prose)
            got = [s for s in _SENTENCE.split(prose) if s.strip()]
            if got:
                out.append(got)
            block.clear()

    for line in text.split("\n"):
        if not line.strip():
            close()
        elif re.match(r"\s*#{1,6}\s", line):
            close()
        else:
            bare = _ASIDE.sub("", line) if "`" in line else line
            bare = _CITED.sub("", bare) if _MAY_CITE.search(bare) else bare
            item = _BULLET.match(bare)
            if item:
                close()
                bare = bare[item.end() :]
            if _CODE_LINE.search(_MARKS.sub("", bare) if item else bare):
                continue
            block.append(bare.strip())
    close()
    return out


class Letters:
    """How much better the letter trigrams of samples explain words than their single letters do, in nats a letter."""

    def __init__(self, sentences: list[list[str]]):
        trigrams, pairs, letters = Counter(), Counter(), Counter()
        for words in sentences:
            line = " " + " ".join(words) + " "
            trigrams.update(map("".join, zip(line, line[1:], line[2:])))
            pairs.update(map("".join, zip(line, line[1:-1])))
            letters.update(line[2:])
        self.total = sum(letters.values())
        self.of = {c: (n + 0.5) / (self.total + 20) for c, n in letters.items()}
        self.odds = {t: math.log((n + 4 * self.of[t[2]]) / ((pairs[t[:2]] + 4) * self.of[t[2]])) for t, n in trigrams.items()}
        self.unseen = {p: math.log(4 / (n + 4)) for p, n in pairs.items()}
        self.mean, self.spread = -math.inf, 0.0

    def gain(self, words: list[str]) -> float:
        line = " " + " ".join(words) + " "
        odds, unseen = self.odds, self.unseen
        return sum(odds[t] if t in odds else unseen.get(t[:2], 0.0) for t in map("".join, zip(line, line[1:], line[2:]))) / max(1, len(line) - 2)

    def tell(self, words: list[str]) -> bool:
        """Whether the words gain as much as words of the language that no sample holds would."""
        return self.gain(words) >= self.mean - 1.5 * self.spread / math.sqrt(max(1, len(words)))


def learn_letters(sentences: list[list[str]], parts: int = 5) -> Letters:
    """The letters of the samples, and how much words gain of which the letters were not learned: part by part of the words."""
    gains: list[float] = []
    for part in range(parts):
        out = {w for s in sentences for w in s if zlib.crc32(w.encode()) % parts == part}
        gains += map(Letters([[w for w in s if w not in out] for s in sentences]).gain, [[w] for w in sorted(out)])
    letters = Letters(sentences)
    if gains:
        letters.mean, letters.spread = float(np.mean(gains)), float(np.std(gains))
    return letters


def _sentences(text: str | None) -> Iterator[list[list[str]]]:
    for p in paragraphs(text):
        words = [_WORD.findall(s.lower().replace("’", "'")) for s in p]
        if sum(map(len, words)) >= 3:
            yield [s for s in words if s]


def english(text: str | None, letters: Letters) -> list[list[str]]:
    """The words of each sentence of the paragraphs that are running English.

    Where function words leave it open, the letters decide; texts in a language as near to English as Danish may pass.
    """
    out = []
    for words in _sentences(text):
        flat = [w for s in words for w in s]
        known = sum(map(ENGLISH.__contains__, flat))
        if known >= FEW * len(flat) and (known >= MANY * len(flat) or letters.tell(flat)):
            out += words
    return out


@lru_cache(100_000)
def syllables(word: str) -> int:
    n = len(_VOWELS.findall(word))
    return max(1, n - (word.endswith("e") and not word.endswith("le") and n > 1))


FEATURES = ("sentence_length", "long_sentences", "connectives", "word_length", "long_words", "very_long_words", "syllables", "vocabulary", "hard_vocabulary", "easy_vocabulary")


def features(sentences: list[list[str]], lexicon: dict[str, float]) -> list[float]:
    """Features of syntax and vocabulary; words the lexicon lacks have no say in the vocabulary's."""
    words = [w for s in sentences for w in s]
    n = max(1, len(words))
    content = [w for w in words if w not in ENGLISH] or words or ["a"]
    lengths = [len(s) for s in sentences] or [0]
    graded = [lexicon[w] for w in content if w in lexicon]
    by_sentence = [sum(g) / len(g) for s in sentences if (g := [lexicon[w] for w in s if w in lexicon and w not in ENGLISH])]
    return [
        math.log1p(sum(lengths) / len(lengths)), sum(x > 18 for x in lengths) / len(lengths), sum(w in ("and", "which", "that", "whose", "if", "because") for w in words) / n,
        sum(map(len, content)) / len(content), sum(len(w) >= 8 for w in content) / len(content), sum(len(w) >= 12 for w in content) / len(content),
        sum(map(syllables, content)) / len(content), sum(graded) / len(graded) if graded else 0.0,
        sum(g > 0.5 for g in by_sentence) / max(1, len(by_sentence)), sum(g < -0.5 for g in by_sentence) / max(1, len(by_sentence)),
    ]


@dataclass
class Model:
    letters: Letters
    lexicon: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # scores, rising
    levels: np.ndarray  # the calibrated level at each knot

    def score(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.scale) @ self.weights

    def level(self, rows: np.ndarray) -> np.ndarray:
        fitted = np.interp(self.score(rows), self.knots, self.levels)
        return np.floor(fitted + 0.5).astype(np.int32)


def isotonic(y: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to y by least squares, by pooling adjacent violators."""
    means: list[float] = []
    sizes: list[int] = []
    for v in y:
        means.append(float(v))
        sizes.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            n = sizes[-2] + sizes[-1]
            means[-2:] = [(means[-2] * sizes[-2] + means[-1] * sizes[-1]) / n]
            sizes[-2:] = [n]
    return np.repeat(means, sizes)


def learn_lexicon(texts: list[list[list[str]]], grades: np.ndarray) -> dict[str, float]:
    """The mean grade of the samples' sentences that hold a word, centred and shrunk towards the middle."""
    total, count = Counter(), Counter()
    middle = float(np.mean(grades))
    for sentences, g in zip(texts, grades):
        for s in sentences:
            for w in set(s):
                total[w] += float(g) - middle
                count[w] += 1
    return {w: total[w] / (count[w] + 2.0) for w in count}


def pairwise_weights(z: np.ndarray, y: np.ndarray, ridge: float, block: int = 512) -> np.ndarray:
    """The weights of a logistic regression on the differences of all pairs of rows of different grades.

    Pairs are summed in blocks of rows: of the differences d = zi - zj, sums of p d and of q d d' need only the sums of p
    and q over rows and columns, and the products of z with q, so that no pair is ever kept.
    """
    w = np.zeros(z.shape[1])
    pairs = max(1, sum(int((y < g).sum()) * int((y == g).sum()) for g in np.unique(y)))
    for _ in range(50):
        s = z @ w
        grad, hess = np.zeros(len(w)), np.zeros((len(w), len(w)))
        for i in range(0, len(y), block):
            rows = slice(i, i + block)
            over = y[rows, None] > y[None, :]
            p = 1 / (1 + np.exp(-np.clip(s[rows, None] - s[None, :], -30, 30)))
            miss, q = np.where(over, 1 - p, 0.0), np.where(over, p * (1 - p), 0.0)
            grad += z[rows].T @ miss.sum(1) - z.T @ miss.sum(0)
            cross = z[rows].T @ (q @ z)
            hess += (z[rows] * q.sum(1)[:, None]).T @ z[rows] + (z * q.sum(0)[:, None]).T @ z - cross - cross.T
        step = np.linalg.solve(hess / pairs + ridge * np.eye(len(w)) / len(y), grad / pairs - ridge * w / len(y))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], grades: list[int], ridge: float = 1.0) -> Model:
    """Learns the ranker from all pairs of texts of different grades, by logistic regression on their differences."""
    y = np.asarray(grades, float)
    same: dict[str, str] = {}  # one object a word, however many texts hold it
    raw = [[[same.setdefault(w, w) for w in s] for p in _sentences(t) for s in p] for t in texts]
    letters = learn_letters([s for p in raw for s in p])
    parsed = [[[same[w] for w in s] for s in english(t, letters)] for t in texts]
    lexicon = learn_lexicon(parsed, y)
    # A text's own words would flatter its vocabulary features: each fifth is described by the lexicon of the others.
    fold = np.arange(len(y)) % 5
    x = np.zeros((len(y), len(FEATURES)))
    for f in range(5):
        other = np.flatnonzero(fold != f)
        part = learn_lexicon([parsed[i] for i in other], y[other]) if len(other) else lexicon
        for i in np.flatnonzero(fold == f):
            x[i] = features(parsed[i], part)
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = (x - mean) / scale
    w = pairwise_weights(z, y, ridge)
    s = z @ w
    order = np.argsort(s, kind="stable")
    return Model(letters, lexicon, mean, scale, w, s[order], isotonic(y[order]))


def reading_levels(docs: DataFrame, samples: DataFrame, min_words: int = MIN_WORDS, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """(doc_id, reading_level) of each document with at least ``min_words`` words of running English outside code.

    docs: doc_id, text. samples: sample_id, reading_level, text; the model is fitted on those of the ``max_samples`` least
    ids that have a level and a text, and needs two different levels. Null, empty, foreign and short texts have no row;
    whole texts are read, however long; repeated rows of docs are repeated; extra columns are ignored; an empty table of
    documents gives no rows.
    """
    rows = samples.filter("reading_level is not null and text is not null").orderBy("sample_id").limit(max_samples).select("reading_level", "text").collect()
    if len({r[0] for r in rows}) < 2:
        raise ValueError("the samples need at least two levels")
    sent = docs.sparkSession.sparkContext.broadcast(fit([r[1] for r in rows], [r[0] for r in rows]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = sent.value
        for b in batches:
            ids, rows = [], []
            for i, t in zip(b["doc_id"], b["text"]):
                s = english(t, model.letters)
                if sum(map(len, s)) >= min_words:
                    ids.append(i)
                    rows.append(features(s, model.lexicon))
            levels = model.level(np.array(rows)) if rows else np.zeros(0, np.int32)
            yield pd.DataFrame({"doc_id": np.array(ids, np.int64), "reading_level": levels})

    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, reading_level int")
