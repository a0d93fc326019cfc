"""Near-duplicate documents by a MinHash LSH forest.

1. One pass over the whole texts gives each document its word-shingle count and a
   signature of ``TREES * DEPTH`` one-permutation minima of 16 bits. A bin that no
   shingle fell into borrows from a bin chosen by a fixed hash, so that equal
   positions of two signatures agree with the Jaccard similarity of the sets.
2. Documents with equal word sequences are one class. Grouping combines on the map
   side, so a class may hold any share of the rows. Classes are numbered, and the
   numbers, not the ids, are what the forest links: two rows may share an id.
3. Each tree of the forest is one sorted order: rows (tree, DEPTH minima, class) are
   range-partitioned and sorted. Rows carry a sketch of two bits of every bin, which
   rejects, inside the sorted pass, pairs that are ``SIGMAS`` standard deviations under
   the threshold; only what is left becomes a row and is confirmed on full shingle sets.
4. The first pass links longest-common-prefix neighbours alone: each row of
   ``FIRST_TREES`` orders with the next ``FIRST_NEAR``. That joins most of any group, however
   large, for a few pairs a row.
5. The second pass goes through all trees and looks only at pairs that aren't in one
   component yet. The prefix starts at ``SHALLOW`` minima; a region of more than
   ``REGION`` rows goes one minimum deeper, and so on, with the ``NEAR`` next rows of the
   order linked across the cut. All pairs of a region of at most ``REGION`` rows are candidates.
   ``ROUND`` trees are sorted at a time: a row of an order is some 110 bytes on disk, so all 40 would be
   4.4 kB a document. The shuffle files of a round go when its pairs are written, so disk holds one round's.
6. Leaves that are still larger at full depth, and those that lie across the border of two
   partitions, are compared in full if they hold more than one component: rows outside
   the leaf's largest component with all its rows, in block pairs dealt to tasks by the bytes
   of their sets, by sketch and then by set. A task gives a spanning forest of its links, so
   rows stay in proportion to rows. The work is rows outside times rows of the leaf.
7. Links make components (``ionlake.llm.components``).

Which texts a pass reads again, and which leaves are compared in full, is known by bitmaps of at
most ``BITMAP`` bits over hashes, broadcasts of bounded size, and then by exact joins. Joins
with sets ask for a sort-merge join, so that nothing that grows with the corpus is broadcast and
a plan tried on a small table is that of a large one.

Recall: a pair at similarity s ends in the same leaf of a tree with at least s**DEPTH, so at
s = 0.85 all 40 trees miss it with odds of at most 3e-6, at 0.8 with 6e-4, in regions of any size; in
regions that need no depth beyond SHALLOW the odds are 1e-13 and 1e-9. Partition borders lose nothing
(step 6), so the number of partitions doesn't matter.

Edge cases: a null or word-less text has no shingles and links with nothing (its
component is itself); a text shorter than the shingle has its whole sequence as
one; every row is a document of its own, so repeated rows of one id and text are copies
of each other, and rows that share an id but not a text are looked at apart, each with
its own component; rows without an id are left out; an empty table gives an empty result;
other columns are not looked at. Very long texts are one value of a batch, all of whose words are
hashed; sets of any size are compared in full. Ties don't matter: the smallest id of a component names it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.components import components
from ionlake.llm.shared import Stage, bitmap_of, fresh, freeing_shuffles, grams, in_bitmap, lower_ascii, mix, only, passes, text_bytes, words

TREES, DEPTH, SHALLOW = 40, 8, 4
BINS = TREES * DEPTH
FIRST_TREES, FIRST_NEAR = 8, 2
#: Trees of the second pass that are sorted, and so lie on disk, at a time.
ROUND = 10
#: Largest region whose pairs are all candidates, and rows linked across a cut of a larger one.
REGION, NEAR = 24, 6
#: Rows and bytes of sets of a block of a leaf that is compared in full.
BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20
BITMAP = 1 << 26
#: Bytes of sorted rows of a partition, where the session's own number of partitions would hold more.
PART_BYTES = 32 << 20
#: Standard deviations under the threshold from which on a sketch rejects (odds of 3e-7 at the threshold).
SIGMAS = 5
#: Sets smaller than this aren't judged by their sketches.
SMALL = 48
#: Tries of a hashed bin before an empty bin takes the filled bin that ranks first for it.
TRIES = 8
#: Bytes of a sketch: two bits of every bin, in two planes.
SKETCH = BINS // 4
#: Bytes of a tree's number and its minima.
KEY = 1 + 2 * DEPTH

_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_tries = mix(np.arange(BINS * TRIES, dtype=np.uint64) + np.uint64(1 << 32)).reshape(TRIES, BINS) % np.uint64(BINS)
_ranks = mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(1 << 40)).reshape(BINS, BINS)


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle (with repeats) and the document it is from."""
    h, word_at, _ = words(data, at)
    counts = np.diff(word_at)
    doc = np.repeat(np.arange(len(counts)), counts)
    g = grams(h, width)
    inside = (doc[: len(g)] == doc[width - 1 : width - 1 + len(g)]) if len(g) else np.zeros(0, bool)
    out, of = [g[inside]], [doc[: len(g)][inside]]
    for n in range(1, width):  # shorter documents: their whole sequence
        short = np.flatnonzero(counts == n)
        if len(short):
            starts = word_at[short]
            with np.errstate(over="ignore"):
                key = np.full(len(short), np.uint64(n) * np.uint64(0xA0761D6478BD642F), np.uint64)
                for j in range(n):
                    key = key * np.uint64(0xD1342543DE82EF95) + h[starts + j]
            out.append(mix(key))
            of.append(short)
    return np.concatenate(out), np.concatenate(of)


def signatures(g: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """uint16 signatures (n_docs, BINS); rows without shingles are zero."""
    sig = np.full(n_docs * BINS, 0xFFFFFFFF, np.uint32)
    where = ((g >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    np.minimum.at(sig, doc * BINS + where.astype(np.int64), (g & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    sig = sig.reshape(n_docs, BINS)
    filled = sig != 0xFFFFFFFF
    source = sig.copy()
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for t in range(TRIES):
        if not len(row):
            break
        take = _tries[t][col].astype(np.int64)
        ok = filled[row, take]
        sig[row[ok], col[ok]] = source[row[ok], take[ok]]
        row, col = row[~ok], col[~ok]
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        for a, b in zip(first, [*first[1:], len(row)], strict=True):
            have = np.flatnonzero(filled[row[a]])
            best = have[np.argmin(_ranks[col[a:b]][:, have], axis=1)]
            sig[row[a], col[a:b]] = source[row[a], best]
    out = (mix(sig.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    out[~filled.any(axis=1)] = 0
    return out


def digest(text: bytes) -> bytes:
    """Of the word sequence, which is what makes rows copies of each other."""
    return hashlib.blake2b(b" ".join(text.translate(_UPPER).split()), digest_size=16).digest()


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            for a, b in passes(at):
                part, off = data[at[a] : at[b]], at[a : b + 1] - at[a]
                g, doc = shingles(lower_ascii(part), off, width)
                order = np.argsort(doc, kind="stable") if len(g) and (np.diff(doc) < 0).any() else slice(None)
                g, doc = g[order], doc[order]
                to = np.searchsorted(doc, np.arange(b - a + 1))
                sizes = []
                for x, y in zip(to[:-1], to[1:], strict=True):
                    s = np.sort(g[x:y])
                    sizes.append(int((s[1:] != s[:-1]).sum()) + 1 if len(s) else 0)
                raw = part.tobytes()
                same = [digest(raw[x:y]) for x, y in zip(off[:-1], off[1:], strict=True)]
                sig = signatures(g, doc, b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())],
                    ["id", "n_shingles", "same", "signature"],
                )

    return run


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width as a matrix of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.binary(width))
    return np.frombuffer(column.buffers()[1], np.uint8).reshape(-1, width)[column.offset : column.offset + len(column)]


def binaries(rows: np.ndarray) -> pa.Array:
    """A matrix of bytes as binary values."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of every bin, as bytes: the low bits of all bins, then the high ones."""
    return np.concatenate([np.packbits(sig & 1, axis=1), np.packbits(sig >> 1 & 1, axis=1)], axis=1)


def keys_of(sig: np.ndarray, first: int, last: int) -> np.ndarray:
    """(rows * trees, KEY) bytes that sort as the trees' orders do: the tree's number and its minima."""
    n, trees = len(sig), last - first
    sig = np.ascontiguousarray(sig[:, first * DEPTH : last * DEPTH].astype(">u2")).reshape(n * trees, DEPTH)
    key = np.zeros((n * trees, KEY), np.uint8)
    key[:, 0] = np.tile(np.arange(first, last, dtype=np.uint8), n)
    key[:, 1:] = sig.view(np.uint8).reshape(n * trees, 2 * DEPTH)
    return key


def signature_of(column: pa.Array) -> np.ndarray:
    return fixed(column, 2 * BINS).view(np.uint16).reshape(len(column), BINS)


def _orders(first: int, last: int):
    """A row for each tree; rows come as (vertex, component, signature, n_shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 1000):
                batch = whole.slice(k, 1000)
                sig, trees = signature_of(batch.column(2)), last - first
                each = np.repeat(np.arange(len(batch)), trees)
                vertex, group, n = (pa.array(batch.column(j).to_numpy()[each], pa.int64()) for j in (0, 1, 3))
                yield pa.RecordBatch.from_arrays([binaries(keys_of(sig, first, last)), vertex, group, n, binaries(sketches(sig)[each])], ["key", "vertex", "component", "n", "sketch"])

    return run


def spread(na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Standard deviation of the share of equal two-bit bins of two sets whose similarity is the threshold.

    Filled bins hold a sample without replacement of the union, which for small unions is
    nearly all of it; bins that borrow repeat filled ones at random. Unequal bins agree in
    two bits by chance, a repeated one together with its source.
    """
    union = (na + nb) / (1 + similarity)
    filled = 0.95 * BINS * -np.expm1(-union / BINS)
    sampled = np.maximum(union - filled, 0) / np.maximum(union - 1, 1) / filled
    again = (BINS - filled) / filled
    chance = (1 - similarity) * 3 / 16 * filled * (1 + 3 * again + again * again) / BINS**2
    return np.sqrt(9 / 16 * similarity * (1 - similarity) * (sampled + (BINS - filled) / BINS**2) + chance)


def likely(x: np.ndarray, y: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sketches (as 64-bit words) don't rule out the threshold; of small sets, all pairs of fitting sizes."""
    half = x.shape[-1] // 2
    low = x[..., :half] ^ y[..., :half]
    unequal = np.bitwise_count(low | (x[..., half:] ^ y[..., half:])).sum(axis=-1, dtype=np.int64)
    least = similarity + (1 - similarity) / 4 - SIGMAS * spread(na, nb, similarity)
    ok = (np.minimum(na, nb) < SMALL) | (unequal <= BINS * (1 - least))
    return ok & (np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9)


def _region(keys: np.ndarray, lo: int, hi: int, depth: int, a: list, b: list, full: list) -> None:
    """Candidate index pairs of the sorted rows lo..hi, which share ``depth`` minima; ``full`` gets leaves that are too large."""
    n = hi - lo
    if n < 2:
        return
    if n <= REGION:
        i, j = np.triu_indices(n, 1)
        a.append(i + lo)
        b.append(j + lo)
        return
    for d in range(1, NEAR + 1):
        a.append(np.arange(lo, hi - d))
        b.append(np.arange(lo + d, hi))
    if depth == DEPTH:
        full.append(lo)
        return
    at = keys[lo:hi, 1 + 2 * depth : 3 + 2 * depth]
    cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1 + lo
    for x, y in zip([lo, *cuts], [*cuts, hi], strict=True):
        _region(keys, x, y, depth + 1, a, b, full)


class Rows:
    """Sorted rows (key, vertex, component, n, sketch) that are at hand."""

    def __init__(self, parts: list[tuple]):
        self.parts = parts
        self.key, self.vertex, self.group, self.n, self.sketch = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts, strict=True))

    @staticmethod
    def of(batch: pa.RecordBatch) -> Rows:
        return Rows([(fixed(batch.column(0), KEY), *(batch.column(k).to_numpy() for k in (1, 2, 3)), fixed(batch.column(4), SKETCH).view(np.uint64))])

    def slice(self, lo: int, hi: int | None = None) -> tuple:
        return tuple(x[lo:hi].copy() for x in (self.key, self.vertex, self.group, self.n, self.sketch))

    def pairs(self, i: np.ndarray, j: np.ndarray, similarity: float) -> pa.RecordBatch:
        """The index pairs that are apart and likely, as pairs of vertices."""
        i, j = (x[self.group[i] != self.group[j]] for x in (i, j))
        ok = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            ok[k : k + (1 << 16)] = likely(self.sketch[x], self.sketch[y], self.n[x], self.n[y], similarity)
        x, y = self.vertex[i[ok]], self.vertex[j[ok]]
        found = np.stack([np.minimum(x, y), np.maximum(x, y)], 1)
        found = np.unique(found, axis=0) if len(found) else found
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.nulls(len(found), pa.binary())], ["a", "b", "leaf"])


def _adjacent(similarity: float):
    """Likely pairs of rows that are next to each other in a sorted partition and share SHALLOW minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            rows = Rows([*([last] if last else []), Rows.of(batch).slice(0)])
            m = len(rows.key)
            i, j = (np.concatenate([f(d) for d in range(1, FIRST_NEAR + 1)]) for f in (lambda d: np.arange(max(m - d, 0)), lambda d: np.arange(min(d, m), m)))
            share = (rows.key[i, : 1 + 2 * SHALLOW] == rows.key[j, : 1 + 2 * SHALLOW]).all(axis=1)
            yield rows.pairs(i[share], j[share], similarity)
            last = rows.slice(max(m - FIRST_NEAR, 0))

    return run


def _neighbours(similarity: float):
    """Likely pairs of a sorted partition; rows with ``leaf`` name what is left to compare in full.

    Rows of a region may come in several batches; they are put together once, when the region ends.
    """
    prefix = 1 + 2 * SHALLOW

    def leaves(key: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
        """Regions of a border's key: which of them is a leaf, the number of its rows in all partitions decides.

        One above full depth is none if the keys near the border hold more than ``REGION`` of it.
        """
        same = np.logical_and.accumulate(near == key, axis=1).sum(axis=0)
        found = [key[: 1 + 2 * d].tobytes() for d in range(SHALLOW, DEPTH + 1) if d == DEPTH or same[2 * d] <= REGION]
        return pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64()), pa.array(found, pa.binary())], ["a", "b", "leaf"])

    def emit(rows: Rows, to: int) -> Iterator[pa.RecordBatch]:
        change = (rows.key[1:to, :prefix] != rows.key[: to - 1, :prefix]).any(axis=1)
        first = np.r_[0, np.flatnonzero(change) + 1]
        size = np.diff(np.r_[first, to])
        a, b, full, held = [], [], [], 0
        for lo, n in zip(first[size > 1], size[size > 1], strict=True):
            if (rows.group[lo : lo + n] != rows.group[lo]).any():
                _region(rows.key, int(lo), int(lo + n), SHALLOW, a, b, full)
                held += n
            if held > 50_000:
                yield rows.pairs(np.concatenate(a), np.concatenate(b), similarity)
                a, b, held = [], [], 0
        if a:
            yield rows.pairs(np.concatenate(a), np.concatenate(b), similarity)
        if full:
            found = binaries(rows.key[full])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64()), found], ["a", "b", "leaf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            now = Rows.of(batch)
            if last is None:
                yield leaves(now.key[0], now.key)
            goes_on = last is not None and (now.key[-1, :prefix] == last[0, :prefix]).all()
            last = now.key[-1:].copy()
            if goes_on:
                held.append(now.slice(0))
                continue
            rows = Rows([*held, now.slice(0)])
            to = int(np.flatnonzero((rows.key[:, :prefix] != last[0, :prefix]).any(axis=1))[-1]) + 1 if (rows.key[0, :prefix] != last[0, :prefix]).any() else 0
            if to:
                yield from emit(rows, to)
            held = [rows.slice(to)]
        if held:
            rows = Rows(held)
            yield leaves(last[0], rows.key)
            if len(rows.key) > 1:
                yield from emit(rows, len(rows.key))

    return run


def _place(column: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(BITMAP))


def _sets(width: int, bitmap: np.ndarray):
    """Digest and sorted shingle hashes of the documents whose place in the bitmap is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bitmap, batch.column(1).to_numpy())))
            data, at = text_bytes(batch.column(0))
            for a, b in passes(at):
                raw = data[at[a] : at[b]].tobytes()
                off = at[a : b + 1] - at[a]
                g, doc = shingles(lower_ascii(data[at[a] : at[b]]), off, width)
                order = np.argsort(doc, kind="stable")
                g, doc = g[order], doc[order]
                to = np.searchsorted(doc, np.arange(b - a + 1))
                found = [np.unique(g[x:y]).tobytes() for x, y in zip(to[:-1], to[1:], strict=True)]
                same = [digest(raw[x:y]) for x, y in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(same, pa.binary()), pa.array(found, pa.binary())], ["same", "hashes"])

    return run


def _confirm(similarity: float):
    percent = round(similarity * 10000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(10000 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _members(bitmap: np.ndarray):
    """The regions of every tree and depth whose place in the bitmap is set; rows come as (vertex, component, signature)."""
    shapes = [(t, d) for t in range(TREES) for d in range(SHALLOW, DEPTH + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sig, vertex, group = signature_of(batch.column(2)), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            chain = region_hashes(sig)
            for t, d in shapes:
                here = np.flatnonzero(in_bitmap(bitmap, (chain[t, d - SHALLOW] & np.uint64(BITMAP - 1)).astype(np.int64)))
                if len(here):
                    keys = keys_of(sig[here], t, t + 1)[:, : 1 + 2 * d]
                    yield pa.RecordBatch.from_arrays([binaries(keys), pa.array(vertex[here]), pa.array(group[here])], ["region", "vertex", "component"])

    return run


def region_hashes(sig: np.ndarray) -> np.ndarray:
    """(trees, depths, rows) hashes of the regions that each row is in."""
    out = np.zeros((TREES, DEPTH - SHALLOW + 1, len(sig)), np.uint64)
    with np.errstate(over="ignore"):
        for t in range(TREES):
            h = np.full(len(sig), t + 1, np.uint64)
            for d in range(DEPTH):
                h = mix(h * np.uint64(0xD1342543DE82EF95) + sig[:, t * DEPTH + d].astype(np.uint64))
                if d + 1 >= SHALLOW:
                    out[t, d + 1 - SHALLOW] = h
    return out


def _region_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each region key, as ``region_hashes`` has it."""
    for batch in batches:
        found = []
        with np.errstate(over="ignore"):
            for key in batch.column(0).to_pylist():
                h = np.full(1, key[0] + 1, np.uint64)
                for x in np.frombuffer(key[1:], ">u2"):
                    h = mix(h * np.uint64(0xD1342543DE82EF95) + np.uint64(x))
                found.append(int(h[0] & np.uint64(BITMAP - 1)))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["place"])


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which of the index pairs join what those before them have not joined."""
    up = list(range(n))
    keep = np.zeros(len(i), bool)
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[y] = x
            keep[k] = True
    return keep


def _across(similarity: float):
    """A spanning forest of the links of one block pair of a leaf, between rows that aren't in one component."""
    percent = round(similarity * 10000)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        vertex, group, n, rest, left = (table.column(c).to_numpy() for c in ("vertex", "component", "n_shingles", "rest", "left"))
        sketch = fixed(table.column("sketch"), SKETCH).view(np.uint64)
        hashes = [np.frombuffer(h.as_buffer(), np.uint64) for h in table.column("hashes")]
        right = np.flatnonzero(~left)
        a, b = [], []
        for i in np.flatnonzero(left):
            # Two rows outside the largest component meet twice; the smaller number's turn counts.
            at = right[(group[right] != group[i]) & (~rest[right] | (vertex[right] > vertex[i]))]
            at = at[likely(sketch[i], sketch[at], n[i], n[at], similarity)]
            for k in range(0, len(at), 256):
                some = at[k : k + 256]
                other = np.concatenate([hashes[j] for j in some])
                place = np.minimum(np.searchsorted(hashes[i], other), len(hashes[i]) - 1)
                shared = np.add.reduceat((hashes[i][place] == other).astype(np.int64), np.cumsum(n[some]) - n[some])
                linked = some[10000 * shared >= percent * (n[i] + n[some] - shared)]
                a.append(np.full(len(linked), i))
                b.append(linked)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        keep = spanning(a, b, len(vertex))
        x, y = vertex[a[keep]], vertex[b[keep]]
        return pa.table([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=schema)

    return run


def near_components(docs: DataFrame, similarity: float, width: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, components): id, n_shingles, vertex of every row with an id; vertex, component_id of every class of equal word sequences."""
    with freeing_shuffles(docs.sparkSession):
        return _near_components(docs, similarity, width, id_col, text_col)


def _near_components(docs: DataFrame, similarity: float, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    stage = Stage(spark, "minhash")
    source = only(docs, id_col, text_col).toDF("id", "text").filter("id IS NOT NULL").withColumn("id", F.col("id").cast("long"))
    described = stage.keep(source.mapInArrow(_describe(width), "id long, n_shingles long, same binary, signature binary"), "described")
    classes = described.filter("n_shingles > 0").groupBy("same").agg(F.min("id").alias("rep"))
    classes = stage.keep(classes.withColumn("vertex", F.monotonically_increasing_id()), "classes")
    members = stage.keep(described.select("id", "n_shingles", "same").join(classes, "same", "left").select("id", "n_shingles", "vertex"), "members")
    firsts = described.join(classes.select("same", F.col("rep").alias("id"), "vertex").hint("shuffle_merge"), ["same", "id"])
    # Repeated rows of one id and text; the join has dealt them by these columns, so signatures move once.
    reps = stage.keep(firsts.dropDuplicates(["same", "id"]).select("vertex", "signature", "n_shingles"), "reps")
    stage.drop("described")
    n_reps, least_parts = reps.count(), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def sets_of(vertices: DataFrame, name: str) -> DataFrame:
        """vertex, hashes for the given vertices, from the texts of their classes' first rows."""
        wanted = stage.keep(classes.join(vertices.distinct().hint("shuffle_merge"), "vertex"), f"wanted_{name}")
        bitmap = bitmap_of(wanted.select(_place(F.col("rep")).alias("place")), BITMAP)
        sets = source.select("text", _place(F.col("id")).alias("place")).mapInArrow(_sets(width, bitmap), "same binary, hashes binary")
        return stage.keep(sets.join(wanted.hint("shuffle_merge"), "same").dropDuplicates(["vertex"]).select("vertex", "hashes"), f"sets_{name}")

    def joined(found: DataFrame) -> DataFrame:
        rows = reps.join(found.hint("shuffle_merge"), "vertex", "left")
        return rows.select("vertex", F.coalesce("component", "vertex").alias("component"), "signature", "n_shingles")

    def sorted_trees(rows: DataFrame, first: int, last: int) -> DataFrame:
        orders = rows.mapInArrow(_orders(first, last), "key binary, vertex long, component long, n long, sketch binary")
        parts = max(least_parts, -(-n_reps * (last - first) * (KEY + SKETCH + 24) // PART_BYTES))
        return orders.repartitionByRange(parts, "key", "vertex").sortWithinPartitions("key", "vertex")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        sets = sets_of(pairs.select(F.col("a").alias("vertex")).unionByName(pairs.select(F.col("b").alias("vertex"))), name)
        checked = pairs.hint("shuffle_merge").join(sets.select(F.col("vertex").alias("a"), F.col("hashes").alias("ha")), "a")
        checked = checked.hint("shuffle_merge").join(sets.select(F.col("vertex").alias("b"), F.col("hashes").alias("hb")), "b")
        links = stage.keep(checked.mapInArrow(_confirm(similarity), "a long, b long"), f"links_{name}")
        stage.drop(f"sets_{name}", f"wanted_{name}", f"pairs_{name}")
        return links

    pair = "a long, b long, leaf binary"
    apart = reps.select("vertex", F.col("vertex").alias("component"), "signature", "n_shingles")
    near = sorted_trees(apart, 0, FIRST_TREES).mapInArrow(_adjacent(similarity), pair)
    links = [confirmed(stage.keep(near.select("a", "b").distinct(), "pairs_near"), "near")]
    linked = Stage(spark, "minhash-near")
    rows = stage.keep(joined(components(links[0], linked)), "rows")
    linked.clear()
    rounds = range(0, TREES, ROUND)
    by_round = [stage.keep(sorted_trees(rows, k, min(k + ROUND, TREES)).mapInArrow(_neighbours(similarity), pair), f"round{k}") for k in rounds]
    region = stage.keep(reduce(DataFrame.unionByName, by_round).distinct(), "pairs_region")
    stage.drop(*[f"round{k}" for k in rounds])
    leaves = stage.keep(region.filter("leaf IS NOT NULL").select(F.col("leaf").alias("region")), "leaves")
    links.append(confirmed(region.filter("leaf IS NULL").select("a", "b"), "region"))
    linked = Stage(spark, "minhash-region")
    found = components(reduce(DataFrame.unionByName, links), linked)
    rows = stage.keep(joined(found), "rows2")
    stage.drop("rows")
    inside = _large_leaves(rows, leaves, stage)
    sets = sets_of(inside.select("vertex"), "full")
    sketch = rows.mapInArrow(_with_sketch, "vertex long, n_shingles long, sketch binary")
    posted = inside.hint("shuffle_merge").join(sketch.join(sets.hint("shuffle_merge"), "vertex"), "vertex")
    links.append(stage.keep(posted.groupBy("region", "x", "y").applyInArrow(_across(similarity), "a long, b long"), "links_full"))
    if not links[-1].isEmpty():
        linked.clear()
        linked = Stage(spark, "minhash-full")
        found = components(reduce(DataFrame.unionByName, links), linked)
    smallest = classes.join(found.hint("shuffle_merge"), "vertex", "left").select("vertex", "rep", F.coalesce("component", "vertex").alias("component"))
    least = smallest.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = stage.keep(smallest.join(least.hint("shuffle_merge"), "component").select("vertex", "component_id"), "named")
    linked.clear()
    stage.drop("sets_full", "wanted_full", "rows2", "reps", "leaves", "inside", "classes", "links_near", "links_region", "links_full")
    return members, named


def _with_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), binaries(sketches(signature_of(batch.column(2))))], ["vertex", "n_shingles", "sketch"])


def _large_leaves(rows: DataFrame, leaves: DataFrame, stage: Stage) -> DataFrame:
    """region, vertex, component, rest, left, x, y: who meets whom in the leaves that are compared in full."""
    places = stage.keep(leaves.mapInArrow(_region_place, "place long"), "places")
    # Every row asks for 200 regions, so few bits would let many through that the join then drops.
    bitmap = bitmap_of(places, BITMAP, 1024)
    members = rows.select("vertex", "component", "signature").mapInArrow(_members(bitmap), "region binary, vertex long, component long")
    members = stage.keep(members.join(leaves.hint("shuffle_merge"), "region").join(rows.select("vertex", "n_shingles").hint("shuffle_merge"), "vertex"), "members_of_leaves")
    parts = members.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    full = parts.groupBy("region").agg(F.sum("n").alias("rows"), F.sum("size").alias("size"), F.max(F.struct("n", "component", "size")).alias("top"), F.count(F.lit(1)).alias("parts"))
    # A region above full depth is a leaf only if it is small.
    full = full.filter((F.col("parts") > 1) & ((F.octet_length("region") == KEY) | (F.col("rows") <= REGION)))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size * 8 / BLOCK_BYTES)).cast("long")
    full = full.select(
        "region", F.col("top.component").alias("top"), blocks(F.col("rows"), F.col("size")).alias("ys"), blocks(F.col("rows") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("xs")
    )
    inside = members.hint("shuffle_merge").join(full, "region").withColumn("rest", F.col("component") != F.col("top"))
    mine = F.xxhash64("vertex", F.lit("block"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    lefts = inside.filter("rest").select("region", "vertex", "component", "rest", F.lit(True).alias("left"), F.pmod(mine, F.col("xs")).alias("x"), all_of("ys").alias("y"))
    rights = inside.select("region", "vertex", "component", "rest", F.lit(False).alias("left"), all_of("xs").alias("x"), F.pmod(mine, F.col("ys")).alias("y"))
    out = stage.keep(lefts.unionByName(rights), "inside")
    stage.drop("places", "members_of_leaves")
    return out


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest reachable id), kept."""
    members, found = near_components(docs, similarity, width, id_col, text_col)
    out = members.join(found, "vertex", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stand for their component, with all their columns; rows without an id stay.

    Of rows that share an id all stay if one of them stands for its component, so that no text without a copy is lost.
    """
    gone, kept = fresh(docs, "_gone_id", "_kept")
    by_id = near_duplicates(docs, similarity, width, id_col, text_col).groupBy(F.col(id_col).alias(gone)).agg(F.max("kept").alias(kept))
    return docs.join(by_id.filter(~F.col(kept)).select(gone), F.col(f"`{id_col}`") == F.col(gone), "left_anti")
