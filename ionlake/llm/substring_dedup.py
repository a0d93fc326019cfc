"""Duplicate passages by relative Lempel-Ziv parsing against content-addressed reference blocks.

A window is ``window`` consecutive words; it is a duplicate if its word sequence
starts anywhere else in the corpus too.

1. Anchors. Every window picks the smallest hash among its ``seed``-word grams, so
   equal windows pick the same gram at the same place. The starts that share a pick
   form an anchor: one row of a few numbers for about every fifteen words.
2. An anchor hash that occurs once can't hold a duplicate. The others are found by
   counting (combined on the map side), and only documents that have one are read
   again; each of their anchors becomes a segment, the words its windows cover.
3. Equal segments of an anchor (by a 128-bit digest) are one row with a count, so that a
   passage in a third of all documents is one row per task.
4. Segments are dealt by anchor hash into reference blocks of bounded size. A block that
   shares no anchor with a document holds none of its windows, so each segment meets
   every block that can match it. A task indexes a block (a suffix array over word numbers,
   by prefix doubling) and parses every segment against it greedily: a factor is the longest
   match with any other place of the block. A factor of a window and more is a duplicate span.
   Windows across factor boundaries may match yet another place and are looked up there.
   Here words are compared, not hashes.
5. An anchor with more than ``REGION`` distinct segments (a common passage in ever different
   surroundings) would fill a task. Its windows are dealt anew by more of their words: those
   around the gram that all windows of a range of places of the gram share (``WIDTHS`` such
   places, at last one, where the shared words are the window). Pieces of the segment are
   then merged, dealt and parsed like segments, so nothing is compared pair by pair.
6. Every segment gets its duplicate starts back, and one pass over the documents
   removes the covered words. Staged tables are deleted once nothing reads them. Which documents
   have repeated anchors or duplicates is known by a bitmap of at most ``BITMAP`` bits, a
   broadcast of bounded size, and then by an exact join, so other texts are not shuffled.

Edge cases: null text has no words; empty texts and texts shorter than the window
keep all words; a passage that repeats inside one document counts; rows are told apart by
id and text (a 64-bit hash), so rows that share an id but not a text are documents of their
own, and repeated rows of one id and text are copies of each other; rows without an id are
left out; an empty table gives an empty result; other columns are not looked at. Very long texts are
one value of a batch and become as many segments as their words give; of equal windows all are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.shared import Stage, bitmap_of, grams, in_bitmap, only, passes, slices, text_bytes, words

SEED = 8
#: Distinct segments of one anchor beyond which its windows are dealt by more of their words.
REGION = 2000
#: Places of the gram in a window that share a piece, for each time that an anchor is dealt anew.
WIDTHS = (7, 1)
#: Segments that a reference block holds on average.
BLOCK = 5_000
BITMAP = 1 << 26


def slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors_of(h: np.ndarray, doc: np.ndarray, window: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, number of starts, weight) of each anchor of word hashes h of documents ``doc``.

    A start's anchor is the smallest gram hash of its window; neighbouring starts with
    the same one share a row. Weight 2 says that the gram is there more than once, so
    that windows of this one row may equal each other.
    """
    n = len(h) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    span = window - seed + 1
    g = grams(h, seed)
    valid = doc[:n] == doc[window - 1 :]
    least = np.where(valid, slide_min(g, span), np.uint64(0))
    first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (doc[1:n] != doc[: n - 1])])
    size = np.diff(np.r_[first, n])
    first, size = first[valid[first]], size[valid[first]]
    if (size > span).any():
        cuts = -(-size // span)
        within = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        last = np.repeat(first + size, cuts)
        first = np.repeat(first, cuts) + within * span
        size = np.minimum(span, last - first)
    edge = np.zeros(span - 1, np.uint64)
    picked = np.flatnonzero(~slide_min(~np.concatenate([edge, least, edge]), span) == g)
    twin = picked[:-1][(g[picked[1:]] == g[picked[:-1]]) & (np.diff(picked) <= span)]
    after = picked[np.minimum(np.searchsorted(picked, twin) + 1, len(picked) - 1)]
    k = np.searchsorted(twin, first)
    weight = np.ones(len(first), np.int64)
    if len(twin):
        there = np.minimum(k, len(twin) - 1)
        weight += (k < len(twin)) & (after[there] <= first + size + span - 2)
    return least[first], first, size, weight


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, at = text_bytes(batch.column(2))
            for a, b in passes(at):
                h, word_at, _ = words(data[at[a] : at[b]], at[a : b + 1] - at[a])
                doc = np.repeat(np.arange(b - a), np.diff(word_at))
                anchor, first, size, weight = anchors_of(h, doc, window)
                of = doc[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(ids[a:b][of], pa.int64()), pa.array(hashes[a:b][of], pa.int64()), pa.array(first - word_at[of], pa.int32()), pa.array(size, pa.int16()), pa.array(weight, pa.int16())],
                    ["anchor", "id", "th", "start", "n", "weight"],
                )

    return run


def _segments(window: int):
    """Text of each anchor's segment; words are joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for i, h, t, found in zip(*(batch.column(c).to_pylist() for c in ("id", "th", "text", "anchors")), strict=True):
                w = (t or "").encode().split()
                for f in found:
                    s = b" ".join(w[f["start"] : f["start"] + f["n"] + window - 1])
                    for column, value in zip(rows, (f["anchor"], i, h, f["start"], hashlib.blake2b(s, digest_size=16).digest(), s), strict=True):
                        column.append(value)
                if len(rows[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)
                    rows = ([], [], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

    names = ["anchor", "id", "th", "start", "key", "segment"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
    return run


def longest_elsewhere(numbers: np.ndarray, longest: int) -> np.ndarray:
    """For each place, the length (at most ``longest``) of its longest match with any other place.

    ``numbers`` are word numbers from 1; 0 ends a segment and matches nothing. Places
    are ordered as in a suffix array (prefix doubling up to ``longest`` words); the
    longest match of a place is then with a neighbour in that order.
    """
    n = len(numbers)
    ends = numbers == 0
    ranks = [np.where(ends, np.int64(numbers.max(initial=0)) + 1 + np.cumsum(ends), numbers.astype(np.int64))]
    reach = 1
    while reach < longest:
        r = ranks[-1]
        ahead = np.zeros(n, np.int64)
        ahead[: n - reach] = r[reach:] + 1
        _, r = np.unique(r * (r.max(initial=0) + 2) + ahead, return_inverse=True)
        ranks.append(r.astype(np.int64))
        reach *= 2
    order = np.argsort(ranks[-1], kind="stable")
    here, there = order[:-1], order[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = here + common, there + common
        inside = (x < n) & (y < n)
        same = np.zeros(len(x), bool)
        same[inside] = ranks[k][x[inside]] == ranks[k][y[inside]]
        common += same.astype(np.int64) << k
    out = np.zeros(n, np.int64)
    out[here] = common
    np.maximum.at(out, there, common)
    return out


def parse(match: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Starts of duplicate windows, from the greedy factors of all segments at once.

    ``match`` has the longest factor from each place; segments are first..last. All
    segments advance together, one factor a step.
    """
    dup = np.zeros(len(match) + 1, np.int64)  # +1 where a run of duplicate starts begins, -1 after it
    at, end = first.copy(), last
    straddle = [np.zeros(0, np.int64)]
    while len(at):
        length = np.minimum(match[at], end - at)
        long = length >= window
        np.add.at(dup, at[long], 1)
        np.add.at(dup, at[long] + length[long] - window + 1, -1)
        boundary = at + np.maximum(length, 1)
        # Windows that begin in this factor and reach over its boundary.
        low = np.maximum(at, boundary - window + 1)
        high = np.minimum(boundary, end - window + 1)
        count = np.maximum(high - low, 0)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        straddle.append(np.repeat(low, count) + within)
        going = boundary < end
        at, end = boundary[going], end[going]
    found = np.cumsum(dup[:-1]) > 0
    check = np.concatenate(straddle)
    found[check[match[check] >= window]] = True
    return found


def _parse_block(window: int):
    def run(table: pa.Table) -> pa.Table:
        segments = [s.encode().split() for s in table.column("segment").to_pylist()]
        number: dict[bytes, int] = {}
        lengths = np.array([len(s) for s in segments], np.int64)
        numbers = np.zeros(int((lengths + 1).sum()), np.int64)
        first = np.cumsum(lengths + 1) - (lengths + 1)
        k = 0
        for s in segments:
            for w in s:
                numbers[k] = number.setdefault(w, len(number) + 1)
                k += 1
            k += 1
        dup = parse(longest_elsewhere(numbers, 2 * window), first, first + lengths, window)
        # A segment with copies is a duplicate from end to end.
        copies = table.column("copies").to_numpy() > 1
        bits = [((1 << max(n - window + 1, 0)) - 1) if c else int(sum(1 << int(j) for j in np.flatnonzero(dup[f : f + max(n - window + 1, 0)]))) for f, n, c in zip(first, lengths, copies, strict=True)]
        return pa.table([table.column("anchor"), table.column("key"), pa.array(bits, pa.int64())], ["anchor", "key", "bits"])

    return run


def pieces_of(segment: bytes, anchor: int, window: int, width: int, seed: int = SEED) -> list[tuple[int, int, bytes, bytes]]:
    """(first start, number of starts, core, words) of the pieces of a segment.

    A window's place is where the anchor's gram first is in it. Starts in a row whose places fall
    in one range of ``width`` places of the same gram share a piece; the core is the words that
    all windows of the range have around the gram, so equal windows have equal cores.
    """
    w = segment.split()
    h, _, _ = words(np.frombuffer(segment, np.uint8), np.array([0, len(segment)]))
    at = np.flatnonzero(grams(h, seed).view(np.int64) == anchor)
    starts = np.arange(len(w) - window + 1)
    gram = at[np.searchsorted(at, starts)]
    low = (gram - starts) // width * width
    high = np.minimum(low + width - 1, window - seed)
    new = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (low[1:] != low[:-1])])
    out = []
    for j, end in zip(new, [*new[1:], len(starts)], strict=True):
        core = w[gram[j] - low[j] : gram[j] + window - high[j]]
        out.append((int(j), int(end - j), b" ".join(core), b" ".join(w[j : end + window - 1])))
    return out


def _pieces(window: int, width: int):
    """The pieces of the segments of crowded anchors, which are dealt by their cores; a piece's own gram stays its anchor's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            for a, g, k, s, c in zip(*(batch.column(x).to_pylist() for x in ("anchor", "gram", "key", "segment", "copies")), strict=True):
                for at, _, core, piece in pieces_of(s.encode(), g, window, width):
                    sub = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=g.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)
                    for column, value in zip(rows, (a, k, at, sub, g, hashlib.blake2b(piece, digest_size=16).digest(), c, piece), strict=True):
                        column.append(value)
                if len(rows[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)
                    rows = ([], [], [], [], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

    names = ["anchor", "key", "at", "sub_anchor", "gram", "sub_key", "copies", "piece"]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for t, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                w = (t or "").encode().split()
                if found:
                    gone = np.zeros(len(w) + 1, np.int64)
                    for f in found:
                        for j in range(f["bits"].bit_length()):
                            if f["bits"] >> j & 1:
                                gone[f["start"] + j] += 1
                                gone[f["start"] + j + window] -= 1
                    stay = np.cumsum(gone)[:-1] == 0
                    edge = np.flatnonzero(np.diff(np.r_[False, ~stay, False]))
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                    kept = b" ".join(x for x, s in zip(w, stay, strict=True) if s)
                    rows.append((len(w), len(w) - int(stay.sum()), kept, spans))
                else:
                    rows.append((len(w), 0, b" ".join(w), []))
            n, removed, kept, spans = zip(*rows, strict=True) if rows else ([],) * 4
            spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), spans], ["id", "n_words", "n_removed", "kept_text", "spans"])

    return run


def _place() -> F.Column:
    return F.pmod(F.xxhash64("id", "th"), F.lit(BITMAP)).alias("place")


def _with_place(source: DataFrame, bitmap: np.ndarray, inside: bool) -> DataFrame:
    """The rows of ``source`` whose place in the bitmap is set, or isn't: texts that a join has nothing for are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = in_bitmap(bitmap, batch.column(3).to_numpy())
            yield batch.select(["id", "th", "text"]).filter(pa.array(found == inside))

    return source.select("id", "th", "text", _place()).mapInArrow(run, "id long, th long, text string")


def _parsed(distinct: DataFrame, window: int, stage: Stage, widths: tuple[int, ...], level: int = 0) -> DataFrame:
    """(anchor, key, bits) of the segments in ``distinct`` (anchor, gram, key, copies, segment; a written table) that have duplicate windows."""
    name = f"level{level}"
    blocks = max(1, -(-distinct.count() // BLOCK))
    calm = distinct
    if widths:
        crowded = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > REGION).select("anchor")
        crowded = stage.keep(crowded, f"crowded_{name}")
        calm = distinct.join(crowded, "anchor", "left_anti")
    dealt = calm.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
    out = dealt.groupBy("block").applyInArrow(_parse_block(window), "anchor long, key binary, bits long").filter("bits <> 0")
    if not widths or crowded.isEmpty():
        return out
    pieces = distinct.join(crowded, "anchor", "left_semi").mapInArrow(_pieces(window, widths[0]), "anchor long, key binary, at int, sub_anchor long, gram long, sub_key binary, copies long, piece string")
    pieces = stage.keep(pieces, f"pieces_{name}")
    merged = pieces.groupBy(F.col("sub_anchor").alias("anchor"), F.col("sub_key").alias("key")).agg(F.first("gram").alias("gram"), F.sum("copies").alias("copies"), F.first("piece").alias("segment"))
    merged = stage.keep(merged, f"merged_{name}")
    found = _parsed(merged, window, stage, widths[1:], level + 1).toDF("sub_anchor", "sub_key", "bits")
    again = pieces.join(found, ["sub_anchor", "sub_key"]).groupBy("anchor", "key").agg(F.expr("bit_or(shiftleft(bits, at))").alias("bits"))
    return out.unionByName(again)


def duplicate_starts(source: DataFrame, window: int, stage: Stage) -> DataFrame:
    """(id, th, start, bits): bit j says that the window from word start + j is a duplicate."""
    anchors = source.mapInArrow(_anchors(window), "anchor long, id long, th long, start int, n short, weight short")
    anchors = stage.keep(anchors, "anchors")
    again = anchors.groupBy("anchor").agg(F.sum("weight").alias("c")).filter("c > 1").select("anchor")
    mine = anchors.join(again, "anchor", "left_semi").groupBy("id", "th").agg(F.collect_set(F.struct("anchor", "start", "n")).alias("anchors"))
    mine = stage.keep(mine, "mine")
    segments = _with_place(source, bitmap_of(mine.select(_place()), BITMAP), True).join(mine, ["id", "th"]).mapInArrow(_segments(window), "anchor long, id long, th long, start int, key binary, segment string")
    segments = stage.keep(segments, "segments")
    stage.drop("anchors", "mine")
    distinct = segments.groupBy("anchor", "key").agg(F.count(F.lit(1)).alias("copies"), F.first("segment").alias("segment")).withColumn("gram", F.col("anchor"))
    distinct = stage.keep(distinct, "distinct")
    places = stage.keep(segments.select("anchor", "key", "id", "th", "start"), "places")
    stage.drop("segments")
    bits = stage.keep(_parsed(distinct, window, stage, WIDTHS), "bits")
    stage.drop(*(x for x in [*stage.live] if x not in ("places", "bits")))
    return places.join(bits, ["anchor", "key"]).select("id", "th", "start", "bits")


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept_text (kept words joined by one space), spans (word ranges removed).

    ``window`` is from SEED to 62 words.
    """
    if not SEED <= window <= 62:
        raise ValueError("window must be from 8 to 62 words")
    stage = Stage(docs.sparkSession, "substring")
    source = only(docs, id_col, text_col).toDF("id", "text").filter("id IS NOT NULL")
    source = source.select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")
    found = stage.keep(duplicate_starts(source, window, stage).groupBy("id", "th").agg(F.collect_set(F.struct("start", "bits")).alias("found")), "found")
    stage.drop("places", "bits")
    bitmap, kept = bitmap_of(found.select(_place()), BITMAP), "id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>"
    whole = _with_place(source, bitmap, False).select("id", "text", F.lit(None).cast(found.schema["found"].dataType).alias("found"))
    cut = _with_place(source, bitmap, True).join(found, ["id", "th"], "left").select("id", "text", "found")
    return whole.mapInArrow(_remove(window), kept).unionByName(cut.mapInArrow(_remove(window), kept)).withColumnRenamed("id", id_col)
