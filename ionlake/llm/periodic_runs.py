"""Runs of periodic words inside documents, by a dictionary of basic factors.

A run is a stretch of words with smallest period p and a length of at least 2p and of
``least_length`` that no neighbouring word extends. All runs of a document are found:

1. For m = 1, 2, 4, ... the factors of m words get names, each from the names of its two
   halves. A factor that occurs once in its document is left out of all longer ones.
2. Occurrences of a factor whose starts are at most m/2 apart form an arithmetic progression.
   A run with a period p in [m, 2m) that starts at i has equal factors at i and i+p, and one of
   the two begins its progression, as else the run would begin earlier. So each occurrence is
   paired with the first ones of the progressions less than 2m away, of which there are at most
   four on each side: n pairs of a level, not n squared, however periodic the text.
3. A pair whose words before it differ and whose names p-m later are equal is a square. It is
   extended to the right; its stretch may have been proposed with several multiples of its
   period, of which the smallest stays.

Documents don't interact: no shuffle. A pass takes documents of about a megabyte together, with
a word of its own between two, so that numpy's calls are long; a longer text is a pass of its own
and needs some 60 bytes a word. Words are told apart as bytes, not by a hash.

Edge cases: a null or empty text, or one without words, has no run and an empty collapsed text.
Rows that share an id, or repeat, are documents of their own. Of runs of equal length the one that
starts first is the longest, then the one of the smaller period. An empty table gives an empty
table; extra columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ionlake.llm.shared import only, passes, text_bytes

#: Bytes that are split into words at a time.
SPLIT_BYTES = 1 << 20
#: Pairs of words that one step of the extension compares.
STEP_WORDS = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Names(dict):
    """Numbers of byte strings, from 0, in the order of their first occurrence."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


def word_numbers(text: bytes, names: Names) -> np.ndarray:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as numbers."""
    parts, at = [np.zeros(0, np.int64)], 0
    while at < len(text):
        end = _SPACE.search(text, at + SPLIT_BYTES)
        to = end.start() if end else len(text)
        split = text[at:to].split()  # of bytes: white space is \x20 and \x09-\x0D
        parts.append(np.fromiter(map(names.__getitem__, split), np.int64, len(split)))
        at = to
    return np.concatenate(parts)


# ---------------------------------------------------------------- runs
def maximal_runs(w: np.ndarray, least_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period.

    ``w`` has a number for each word, and one that occurs nowhere else at both of its ends
    and between documents; documents share no numbers.
    """
    n, m = len(w), 1
    name, at = np.full(n, -1, np.int64), np.arange(n)
    key, found = w, []
    while len(at):
        order = np.argsort(key, kind="stable")  # by factor, then by place
        key, at = key[order], at[order]
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        number = np.cumsum(first) - 1
        again = np.bincount(number, minlength=1)[number] > 1
        at, number = at[again], number[again]
        if not len(at):
            break
        name[:] = -1
        name[at] = number
        found.append(_squares(w, name, at, number, m, least_length))
        at = np.sort(at)
        at = at[at + m < n]
        at = at[name[at + m] >= 0]
        key = name[at] * np.int64(n) + name[at + m]
        m *= 2
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    same = np.zeros(len(start), bool)  # the stretch of the row before, with a multiple of its period
    same[1:] = (start[1:] == start[:-1]) & (length[1:] == length[:-1])
    start, length, period = start[~same], length[~same], period[~same]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _squares(w: np.ndarray, name: np.ndarray, at: np.ndarray, number: np.ndarray, m: int, least_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of stretches with a period in [m, 2m); ``at``: places by factor, then place."""
    opens = np.ones(len(at), bool)  # a progression
    opens[1:] = (number[1:] != number[:-1]) | (2 * (at[1:] - at[:-1]) > m)
    which, head = np.cumsum(opens) - 1, at[opens]
    head_number = number[opens]
    starts, periods = [], []
    for side in (1, -1):  # first ones of later progressions, then of earlier ones
        left, step = np.arange(len(at)), 0
        while len(left):
            step += side
            other = which[left] + step
            left, other = left[(other >= 0) & (other < len(head))], other[(other >= 0) & (other < len(head))]
            gap = side * (head[other] - at[left])
            near = (head_number[other] == number[left]) & (gap < 2 * m)
            left, other, gap = left[near], other[near], gap[near]
            far = gap >= m
            starts.append(at[left[far]] if side > 0 else head[other[far]])
            periods.append(gap[far])
    i, p = np.concatenate(starts), np.concatenate(periods)
    ok = w[i - 1] != w[i + p - 1]
    i, p = i[ok], p[ok]
    last = np.minimum(i + 2 * p - m, len(w) - 1)
    ok = (name[i + p - m] >= 0) & (name[i + p - m] == name[last])
    i, p = i[ok], p[ok]
    length = _ends(w, i + p, p) - i + p
    ok = length >= least_length
    return i[ok], length[ok], p[ok]


def _ends(w: np.ndarray, at: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The first z >= at with w[z] != w[z+p]; the word at the end of ``w`` differs from all."""
    at, left, wide, end = at.copy(), np.arange(len(at)), 8, len(w) - 1
    while len(left):
        size = max(1, STEP_WORDS // wide)
        still = []
        for a in range(0, len(left), size):
            k = left[a : a + size]
            z = at[k][:, None] + np.arange(wide)
            differ = w[np.minimum(z, end)] != w[np.minimum(z + p[k][:, None], end)]
            stop = differ.any(axis=1)
            at[k] += np.where(stop, differ.argmax(axis=1), wide)
            still.append(k[~stop])
        left = np.concatenate(still)
        wide = min(2 * wide, STEP_WORDS)
    return at


# ---------------------------------------------------------------- documents
def _answer(texts: list[bytes], least_length: int) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Words, runs, the runs end to end, and collapsed texts of the documents of a pass."""
    words, names, before = [np.array([-1])], [], 0
    for k, text in enumerate(texts):
        own = Names()
        words += [word_numbers(text, own) + before, np.array([-2 - k])]
        names += own
        before += len(own)
    sizes = [len(x) for x in words[1::2]]
    first = np.cumsum([1, *[n + 1 for n in sizes]])[:-1]  # where each document begins
    w = np.concatenate(words)
    start, length, period = maximal_runs(w, least_length)
    change = np.zeros(len(w) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    stays = np.cumsum(change)[:-1] == 0
    of = np.searchsorted(first, start, side="right") - 1
    collapsed = [b" ".join(map(names.__getitem__, w[a : a + n][stays[a : a + n]].tolist())).decode() for a, n in zip(first.tolist(), sizes, strict=True)]
    return sizes, np.bincount(of, minlength=len(texts)).tolist(), start - first[of], length, period, collapsed


def find_runs(docs: DataFrame, least_length: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_words, runs (start, length, period; by start, then period) and collapsed_text of every document.

    The collapsed text has the words that no run contains after its first period, joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            for a, b in passes(at):
                sizes, counts, start, length, period, collapsed = _answer([data[x:y].tobytes() for x, y in zip(at[a:b], at[a + 1 : b + 1], strict=True)], least_length)
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), runs)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sizes, pa.int64()), lists, pa.array(collapsed, pa.string())], ["id", "n_words", "runs", "collapsed_text"])

    source = only(docs, id_col, text_col)
    kind = source.schema[0].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
