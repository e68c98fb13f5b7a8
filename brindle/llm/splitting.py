"""Oversized byte strings cut into overlapping pieces at natural boundaries.

The data are a sequence of tokens (words, blanks and line ends); the prefix sums of their lengths are the offsets at which
tokens end, a sorted array, and each has the rank of the boundary that lies there: of a paragraph, a line, a sentence or a
word. A piece ends at the last boundary within the limit, found by binary search, of the highest rank that leaves it at
least half full; else at the last one of any rank; else at a hard cut between characters. The next piece begins the
overlap before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LIMIT, OVERLAP = 4096, 256
PARAGRAPH, LINE, SENTENCE, WORD, HARD, END = "paragraph", "line", "sentence", "word", "hard", "end"
LEVELS = (PARAGRAPH, LINE, SENTENCE, WORD)
#: Line ends alone, before and after their own bytes.
LINES_ONLY = "lines only"


def boundaries(data: np.ndarray) -> dict[str, np.ndarray]:
    """The sorted offsets of each level's boundaries; those of a level hold those of the levels above it.

    LF, CRLF and a lone CR end lines. A paragraph ends after blank lines, a sentence after a full stop, question or
    exclamation mark and the blanks behind it (or one of the full-width marks), a word after its blanks.
    """
    n = len(data)
    lf, cr = data == 10, data == 13
    blank = (data == 32) | (data == 9) | (data == 11) | (data == 12)
    # The kinds of token: 0 a word, 1 blanks, 2 a line end; a CR and its LF are one.
    kind = np.where(lf | cr, 2, blank.astype(np.int8))
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == 2) & ~(lf[1:] & cr[:-1]))
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, n))
    ends = np.cumsum(lengths)
    kinds = kind[starts]
    following = np.append(kinds[1:], 0)
    is_line = kinds == 2
    # The last token before each line end that is no blank: none since the line end before makes the line blank.
    at = np.arange(len(kinds))
    ended = np.maximum.accumulate(np.where(is_line, at, -1))
    worded = np.maximum.accumulate(np.where(kinds == 0, at, -1))
    before = np.append(-1, ended[:-1])
    empty_line = is_line & (worded <= before)
    next_line_empty = np.zeros(len(kinds), bool)
    line_at = np.flatnonzero(is_line)
    next_line_empty[line_at[:-1]] = empty_line[line_at[1:]]
    is_paragraph = empty_line & ~next_line_empty
    last = data[ends - 1]
    stop = (kinds == 0) & ((last == 46) | (last == 33) | (last == 63))
    is_sentence = (kinds == 1) & np.append(False, stop[:-1])
    is_word = ((kinds == 1) & (following == 0)) | is_sentence | is_line
    wide = np.zeros(0, np.int64)
    if n > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        wide = np.flatnonzero(((a == 0xE3) & (b == 0x80) & (c == 0x82)) | ((a == 0xEF) & (b == 0xBC) & ((c == 0x81) | (c == 0x9F)))) + 3
    contents = np.append(starts[is_line], n)
    return {
        PARAGRAPH: ends[is_paragraph],
        LINE: ends[is_line],
        SENTENCE: np.union1d(ends[is_line | is_sentence], wide),
        WORD: np.union1d(ends[is_word], wide),
        HARD: np.flatnonzero((data & 0xC0) != 0x80),
        LINES_ONLY: np.union1d(contents, ends[is_line]),
    }


def cuts(raw: bytes, limit: int = LIMIT, overlap: int = OVERLAP, levels: tuple[str, ...] = LEVELS) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pieces of raw; kind tells what the end is: a level, hard, or end of the data.

    Every piece has at most ``limit`` bytes. Consecutive pieces share ``overlap`` bytes, or up to 3 more where the piece
    would begin inside a UTF-8 character. Bytes that are no UTF-8 are kept as they are. Empty data has no pieces.
    """
    if not 0 <= overlap < limit - 8:
        raise ValueError("the overlap must be at least 8 bytes less than the limit")
    n = len(raw)
    if n <= limit:
        return [(0, n, END)] if n else []
    bounds = boundaries(np.frombuffer(raw, np.uint8))
    chars = bounds[HARD]

    def last(at: np.ndarray, least: int, most: int) -> int:
        i = int(np.searchsorted(at, most, "right")) - 1
        return int(at[i]) if i >= 0 and at[i] > least else -1

    # Where pieces overlap, an end must lie behind the next start, however far that is moved to a character's beginning.
    ahead = overlap + 4 if overlap else 0
    out, start = [], 0
    while n - start > limit:
        most = start + limit
        for kind, least in [(x, start + limit // 2) for x in levels if x != WORD] + [(x, start + ahead) for x in (*levels, HARD)]:
            if (end := last(bounds[kind], least, most)) > 0:
                break
        else:
            end, kind = most, HARD
        out.append((start, end, kind))
        back = end - overlap
        at = last(chars, back - 4, back) if overlap else back
        start = at if at > start else back
    out.append((start, n, END))
    return out


def forced(raw: bytes, limit: int = LIMIT) -> bool:
    """Whether cuts at line ends alone, without overlap, cannot keep every piece within the limit."""
    return any(kind == HARD for _, _, kind in cuts(raw, limit, 0, (LINES_ONLY,)))


def split_bodies(bodies: DataFrame, key: str = "body_hash", data: str = "bytes", limit: int = LIMIT, overlap: int = OVERLAP, with_bytes: bool = False) -> DataFrame:
    """A row for each piece of each row of bodies: key, piece_no, chunk_id, start_byte, end_byte, cut, forced[, piece].

    cut is where the piece ends: paragraph, line, sentence, word, hard or end. forced tells whether cutting the whole data
    at line ends alone needs hard cuts, which it does if a line has more than ``limit`` bytes. chunk_id is the SHA-256 of key, offsets and
    bytes, the same for the same piece. Null or empty data have no pieces and a null key is the key ''; repeated rows give
    repeated pieces of equal chunk_id. Extra columns are ignored. Each row is cut where it is: nothing is shuffled.
    """
    fields = f"{key} string, piece_no int, chunk_id string, start_byte bigint, end_byte bigint, cut string, forced boolean" + ", piece binary" * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not raw:
                    continue
                hard = forced(raw, limit)
                for no, (s, e, kind) in enumerate(cuts(raw, limit, overlap)):
                    digest = hashlib.sha256(f"{k or ''}|{s}|{e}|".encode() + raw[s:e]).hexdigest()
                    rows.append((k or "", no, digest, s, e, kind, hard, raw[s:e]))
            cols = list(zip(*rows)) if rows else [()] * 8
            types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
            names = [key, "piece_no", "chunk_id", "start_byte", "end_byte", "cut", "forced", "piece"]
            take = 8 if with_bytes else 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:take], types)], names=names[:take])

    return bodies.select(key, data).mapInArrow(run, fields)
