"""Combined traces and the spans found in them (H1 to H3), in pieces of bounded size.

A combined trace is as long as all times of all files, so it is never one row on its way: it is cut into
pieces where the times themselves are dense, and what a span needs of the whole (its top, its base, the nearest
low points on both sides) are aggregates over the pieces' points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionlake.sources.staging import staged

#: Fixed values of span detection: search window, share of the height, least and most width, smoothing.
APEX_WINDOW, SHARE, LEAST_WIDTH, MOST_WIDTH, SIGMA = 15.0, 0.10, 5.0, 120.0, 2.0
#: Points on both sides that the smoothing of a point looks at, and the least length that is smoothed.
HALO, LEAST_SMOOTHED = int(4 * SIGMA + 0.5), 6
#: Values that one task of a median computes, about, points of a piece else, and quantiles of a peak's times that cuts are taken from.
TASK_VALUES, TASK_POINTS, QUANTILES = 20_000_000, 50_000, 1000

SEGMENT = "peak_label string, usable long, piece int, file string, t0 double, y0 double, t1 double, y1 double, last boolean, alone boolean, since double, until double"
#: A segment with an end in the piece, or (with ``covers``) what is left of so many segments that reach across all of it.
DEALT = "peak_label string, usable long, piece int, t0 double, y0 double, t1 double, y1 double, last boolean, alone boolean, since double, until double, covers long"
PIECE = "peak_label string, piece int, t array<double>, i array<double>"


# ---------------------------------------------------------------- pieces
def cuts(bins: int, quantiles: np.ndarray | None) -> np.ndarray:
    """Where a peak's times are cut: at quantiles, and beyond their number into equal parts between two of them."""
    if bins <= 1 or quantiles is None or not len(quantiles):
        return np.zeros(0)
    cells = min(bins, len(quantiles))
    ends = np.asarray(quantiles, float)[np.linspace(0, len(quantiles) - 1, cells + 1).astype(int)]
    parts = -(-bins // cells)
    inner = ends[:-1, None] + (ends[1:] - ends[:-1])[:, None] * np.arange(parts) / parts
    return np.unique(inner.ravel())[1:]


def _deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The segments between a trace's points, in each piece that they reach into; a trace of one point gives its time."""
    for b in batches:
        for peak, file, usable, cut, t, y in zip(b["peak_label"], b["ms_file_label"], b["usable"], b["cuts"], b["t"], b["i"], strict=True):
            edges = np.concatenate([[-np.inf], cut, [np.inf]])
            t, y = np.asarray(t, float), np.asarray(y, float)
            piece = np.searchsorted(edges[1:-1], t, "right")
            n = len(t) - 1
            if n < 1:
                place, at = np.arange(len(t)), piece
                values = {"t0": t, "y0": np.nan, "t1": np.nan, "y1": np.nan, "last": False, "alone": True}
            else:
                low, high = np.minimum(piece[:-1], piece[1:]), np.maximum(piece[:-1], piece[1:])
                size = high - low + 1
                place = np.repeat(np.arange(n), size)
                at = low[place] + np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
                values = {"t0": t[place], "y0": y[place], "t1": t[place + 1], "y1": y[place + 1], "last": place == n - 1, "alone": False}
            if len(place):
                yield pd.DataFrame({"peak_label": peak, "usable": usable, "piece": at.astype(np.int32), "file": file, **values, "since": edges[at], "until": edges[at + 1]})


# Segments as lines over cells in a row (times of a grid, or pieces): each is dealt to few nodes of a binary tree
# over the cells that it reaches across, so that no row or value is made for each segment and cell.
def _nodes(low: np.ndarray, high: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(node, segment) by level, from the leaves up, of segments over the cells [low, high); ``size`` is a power of two."""
    seg = np.flatnonzero(low < high)
    left, right = low[seg] + size, high[seg] + size
    out = []
    while size:
        a, b = left % 2 == 1, right % 2 == 1
        if size == 1:
            a, b = left < right, np.zeros(len(seg), bool)
        out.append((np.concatenate([left[a], right[b] - 1]), np.concatenate([seg[a], seg[b]])))
        left, right, size = (left + a) // 2, (right - b) // 2, size // 2
        go = left < right
        left, right, seg = left[go], right[go], seg[go]
    return out


def _highest(node: np.ndarray, ya: np.ndarray, yb: np.ndarray) -> np.ndarray:
    """Places of the lines that no other line of their node is over at both ends; of equal ones, one."""
    order = np.lexsort((-yb, -ya, node))
    rank = np.unique(yb[order], return_inverse=True, equal_nan=True)[1].astype(np.int64)
    start = np.concatenate([[False], np.diff(node[order]) != 0])
    key = np.cumsum(start) * (len(rank) + 1) + rank
    return order[np.concatenate([[True], np.maximum.accumulate(key)[:-1] < key[1:]])]


def upper_lines(low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray, at) -> tuple[np.ndarray, np.ndarray]:
    """(cell, segment) of the segments over the cells [low, high) that may be the largest somewhere in a cell.

    A cell reaches from time ``first`` to ``last``; ``at`` gives the values of segments at times. Segments are lines,
    so one that is under another at both ends of a node is under it in all of the node's cells.
    """
    size = 1 << max(0, int(len(first) - 1).bit_length())
    node = seg = np.zeros(0, np.int64)
    levels = _nodes(low, high, size)
    for depth, (own, mine) in enumerate(reversed(levels)):
        node, seg = np.concatenate([node, own]), np.concatenate([seg, mine])
        if len(node):
            width = size >> depth
            cell = (node - (1 << depth)) * width
            kept = _highest(node, at(seg, first[cell]), at(seg, last[cell + width - 1]))
            node, seg = node[kept], seg[kept]
        if depth < len(levels) - 1:
            node, seg = np.concatenate([2 * node, 2 * node + 1]), np.tile(seg, 2)
    return node - size, seg


def summed_lines(low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray, at) -> tuple[np.ndarray, np.ndarray]:
    """Sums over each cell's segments of their values at the cell's ``first`` and ``last`` time."""
    size = 1 << max(0, int(len(first) - 1).bit_length())
    times = [np.concatenate([t, np.full(size - len(t), t[-1])]) for t in (first, last)]
    begin = end = np.zeros(1)
    levels = _nodes(low, high, size)
    for depth, (own, mine) in enumerate(reversed(levels)):
        width, n = size >> depth, 1 << depth
        ta, tb = times[0][::width], times[1][width - 1 :: width]
        if depth:
            whole = np.repeat(np.arange(n // 2), 2)
            share = lambda t: np.divide(t - over[0][whole], over[1][whole] - over[0][whole], out=np.zeros(n), where=over[1][whole] > over[0][whole])  # noqa: E731, B023
            begin, end = (begin[whole] + (end - begin)[whole] * share(t) for t in (ta, tb))
        k = own - n
        begin = begin + np.bincount(k, at(mine, ta[k]), n)
        end = end + np.bincount(k, at(mine, tb[k]), n)
        over = ta, tb
    return begin[: len(first)], end[: len(first)]


def values_at(t0: np.ndarray, y0: np.ndarray, t1: np.ndarray, y1: np.ndarray):
    """The values of segments, by number, at times."""

    def at(seg: np.ndarray, t: np.ndarray) -> np.ndarray:
        share = np.divide(t - t0[seg], t1[seg] - t0[seg], out=np.ones(len(seg)), where=t1[seg] > t0[seg])
        return y0[seg] + (y1[seg] - y0[seg]) * share

    return at


def _deal_lines(method: str):
    """Segments of traces to the pieces that they begin or end in; what covers whole pieces as its largest lines or its sum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for peak, own in b.groupby("peak_label", sort=False, dropna=False):
                edges = np.concatenate([[-np.inf], own["cuts"].iloc[0], [np.inf]])
                n = np.array([len(t) for t in own["t"]])
                t, y = (np.concatenate([np.asarray(v, float) for v in own[c]]) if len(own) else np.zeros(0) for c in ("t", "i"))
                if not len(t):
                    continue
                piece, ends = np.searchsorted(edges[1:-1], t, "right"), np.cumsum(n)
                final = np.zeros(len(t), bool)
                final[ends[n > 0] - 1] = True
                head, alone = np.flatnonzero(~final), ends[n == 1] - 1
                done = final[head + 1]
                t0, y0, t1, y1, low, high = t[head], y[head], t[head + 1], y[head + 1], piece[head], piece[head + 1]
                apart = np.flatnonzero(low != high)
                place, where = np.concatenate([np.arange(len(head)), apart]), np.concatenate([low, high[apart]])
                out = [{"piece": where, "t0": t0[place], "y0": y0[place], "t1": t1[place], "y1": y1[place], "last": done[place], "alone": False, "covers": -1}]
                out.append({"piece": piece[alone], "t0": t[alone], "y0": np.nan, "t1": np.nan, "y1": np.nan, "last": False, "alone": True, "covers": -1})
                if (low + 1 < high).any():
                    across = np.flatnonzero(low + 1 < high)
                    values = values_at(t0[across], y0[across], t1[across], y1[across])
                    a, z, inner = low[across], high[across] - 1, len(edges) - 3  # cells are the pieces but for the first and last
                    count = np.cumsum(np.bincount(a, minlength=inner + 1) - np.bincount(z, minlength=inner + 1))[:inner]
                    if method == "max":
                        cell, seg = upper_lines(a, z, edges[1:-2], edges[2:-1], values)
                        seg = across[seg]
                        first = np.unique(cell, return_index=True)[1]
                        covers = np.zeros(len(cell), np.int64)
                        covers[first] = count[cell[first]]
                        out.append({"piece": cell + 1, "t0": t0[seg], "y0": y0[seg], "t1": t1[seg], "y1": y1[seg], "last": False, "alone": False, "covers": covers})
                    else:
                        begin, end = summed_lines(a, z, edges[1:-2], edges[2:-1], values)
                        cell = np.flatnonzero(count)
                        out.append({"piece": cell + 1, "t0": edges[cell + 1], "y0": begin[cell], "t1": edges[cell + 2], "y1": end[cell], "last": False, "alone": False, "covers": count[cell]})
                for rows in out:
                    if len(rows["piece"]):
                        k = rows["piece"]
                        yield pd.DataFrame({"peak_label": peak, "usable": own["usable"].iloc[0], **rows, "piece": k.astype(np.int32), "since": edges[k], "until": edges[k + 1]})

    return run


def combine_lines(grid: np.ndarray, segments: pd.DataFrame, usable: int, method: str) -> np.ndarray:
    """``combine_segments`` for max and mean without a value for each segment and time; rows with ``covers`` are over all of the grid."""
    t0, y0, t1, y1, covers = (segments[c].to_numpy() for c in ("t0", "y0", "t1", "y1", "covers"))
    low = np.where(covers < 0, np.searchsorted(grid, t0, "left"), 0)
    high = np.where(segments["last"].to_numpy().astype(bool), np.searchsorted(grid, t1, "right"), np.searchsorted(grid, t1, "left"))
    high = np.where(covers < 0, np.maximum(high, low), len(grid))
    at = values_at(t0, y0, t1, y1)
    if method == "mean":
        return summed_lines(low, high, grid, grid, at)[0] / usable
    own = covers < 0
    covered = np.cumsum(np.bincount(low[own], minlength=len(grid) + 1) - np.bincount(high[own], minlength=len(grid) + 1))[: len(grid)] + covers[~own].sum()
    cell, seg = upper_lines(low, high, grid, grid, at)
    total = np.full(len(grid), -np.inf)
    np.maximum.at(total, cell, at(seg, grid[cell]))
    return np.where(covered < usable, np.maximum(total, 0), total)


def combine_segments(grid: np.ndarray, segments: pd.DataFrame, usable: int) -> np.ndarray:
    """Median at each grid time; segments (t0, y0, t1, y1, last) are half open but for a trace's last."""
    t0, y0, t1, y1 = (segments[c].to_numpy() for c in ("t0", "y0", "t1", "y1"))
    low = np.searchsorted(grid, t0, "left")
    high = np.where(segments["last"].to_numpy().astype(bool), np.searchsorted(grid, t1, "right"), np.searchsorted(grid, t1, "left"))
    n = np.maximum(high - low, 0)
    seg = np.repeat(np.arange(len(n)), n)
    idx = low[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    value = values_at(t0, y0, t1, y1)(seg, grid[idx])
    covered = np.bincount(idx, minlength=len(grid))
    order = np.lexsort((value, idx))
    idx, value = idx[order], value[order]
    first = np.searchsorted(idx, np.arange(len(grid)))
    below = np.searchsorted(idx, np.arange(len(grid)), "left") + np.bincount(idx[value < 0], minlength=len(grid)) - first
    zeros = usable - covered

    def ranked(k: np.ndarray) -> np.ndarray:
        """The k-th smallest value at each time, where files that don't cover it count as 0."""
        own = first + np.where(k < below, k, k - zeros)
        inside = (k >= below) & (k < below + zeros)
        return np.where(inside, 0.0, value[np.clip(own, 0, max(len(value) - 1, 0))] if len(value) else 0.0)

    k = np.full(len(grid), usable)
    return (ranked((k - 1) // 2) + ranked(k // 2)) / 2


def combined_pieces(traces: DataFrame, method: str = "max", task_values: int | None = None) -> DataFrame:
    """H1 in pieces (PIECE): peaks of several traces, on the union of their files' times; files count as 0 outside their own.

    ``method`` is max, mean or median. Peaks whose traces all have one point give nothing. Max and mean send each segment
    to the pieces of its ends only and what lies between as lines, so their rows grow as the points; a median needs
    every file's value at every time.
    """
    per_task, lines = TASK_VALUES if task_values is None else task_values, method != "median"
    rows = traces.select("peak_label", "ms_file_label", F.col("scan_time").cast("array<double>").alias("t"), F.col("intensity").cast("array<double>").alias("i"))
    stats = rows.groupBy("peak_label").agg(F.count(F.lit(1)).alias("n_traces"), F.count_if(F.size("t") > 1).alias("usable"), F.sum(F.size("t")).alias("n"))
    least = F.ceil(F.col("n") / min(per_task, TASK_POINTS)) if lines else F.ceil(F.col("n") * F.col("usable") / per_task)
    stats = stats.filter("n_traces > 1 AND usable > 0").select("peak_label", "usable", F.greatest(F.lit(1), F.least(F.col("n"), least)).cast("int").alias("bins"))
    long_ = rows.join(stats.filter("bins > 1"), "peak_label").select("peak_label", "bins", F.explode("t").alias("t"))
    shares = [k / QUANTILES for k in range(QUANTILES + 1)]
    dense = long_.groupBy("peak_label", "bins").agg(F.percentile_approx("t", shares, 10 * QUANTILES).alias("quantiles"))
    cut = F.pandas_udf(lambda n, q: pd.Series([cuts(int(a), b) for a, b in zip(n, q, strict=True)]), "array<double>")
    cut_at = dense.select("peak_label", cut("bins", "quantiles").alias("cuts"))
    given = rows.join(stats.drop("bins"), "peak_label").join(cut_at, "peak_label", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        usable, alone = int(pdf["usable"].iloc[0]), pdf["alone"].to_numpy()
        own = ~alone & (pdf["covers"].to_numpy() < 0) if lines else ~alone
        times = np.concatenate([pdf.loc[alone | own, "t0"].to_numpy(), pdf.loc[own, "t1"].to_numpy()])
        grid = np.unique(times[(times >= pdf["since"].iloc[0]) & (times < pdf["until"].iloc[0])])
        if not len(grid):
            return pd.DataFrame(columns=["peak_label", "piece", "t", "i"], dtype=object)
        value = combine_lines(grid, pdf[~alone], usable, method) if lines else combine_segments(grid, pdf[~alone], usable)
        return pd.DataFrame({"peak_label": [pdf["peak_label"].iloc[0]], "piece": [int(pdf["piece"].iloc[0])], "t": [grid.tolist()], "i": [value.tolist()]})

    dealt = given.mapInPandas(_deal_lines(method), DEALT) if lines else given.mapInPandas(_deal, SEGMENT)
    return dealt.groupBy("peak_label", "piece").applyInPandas(run, PIECE)


def single_traces(traces: DataFrame) -> DataFrame:
    """(peak_label, t, i) of the peaks that have one trace."""
    one = traces.groupBy("peak_label").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("peak_label")
    return traces.join(one, "peak_label", "left_semi").select("peak_label", F.col("scan_time").cast("array<double>").alias("t"), F.col("intensity").cast("array<double>").alias("i"))


def combine_traces(traces: DataFrame, method: str = "max", task_values: int | None = None) -> DataFrame:
    """H1: one combined trace per peak, as a row, for those who want it whole.

    A single trace stays as it is; of peaks whose traces all have one point nothing is left.
    """
    whole = combined_pieces(traces, method, task_values).groupBy("peak_label").agg(F.array_sort(F.collect_list(F.struct("piece", "t", "i"))).alias("r"))
    usable = traces.groupBy("peak_label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("scan_time") > 1).alias("u"))
    empty = F.array().cast("array<double>")
    bare = usable.filter("n > 1 AND u = 0").select("peak_label", empty.alias("scan_time"), empty.alias("intensity"))
    return whole.select("peak_label", F.flatten("r.t").alias("scan_time"), F.flatten("r.i").alias("intensity")).unionByName(single_traces(traces).toDF("peak_label", "scan_time", "intensity")).unionByName(bare)


# ---------------------------------------------------------------- spans
def weights() -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-HALO, HALO + 1) / SIGMA) ** 2)
    return k / k.sum()


def smoothed_points(pieces: DataFrame) -> DataFrame:
    """(peak_label, place, n, t, s) of all points: the place in the peak's n points, and the smoothed value.

    ``pieces`` (PIECE) should be a written table. The smoothing of a piece needs HALO points before
    and after it, which its neighbours send; at the ends of a trace the signal is mirrored.
    """
    order = Window.partitionBy("peak_label").orderBy("piece")  # over a row a piece, without its points
    sizes = pieces.select("peak_label", "piece", F.size("t").cast("long").alias("size"))
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before).withColumn("n", F.sum("size").over(Window.partitionBy("peak_label")))
    placed = pieces.join(sizes, ["peak_label", "piece"])
    ends = F.array_distinct(F.concat(F.sequence(F.lit(0), F.least(F.lit(HALO), F.col("size").cast("int")) - 1), F.sequence(F.greatest(F.col("size").cast("int") - HALO, F.lit(0)), F.col("size").cast("int") - 1)))
    sent = placed.select("peak_label", "before", "i", F.explode(ends).alias("k")).select("peak_label", (F.col("before") + F.col("k")).alias("place"), F.get("i", F.col("k")).alias("y"))
    after = F.col("before") + F.col("size")
    asked = sizes.select("peak_label", "piece", "n", F.posexplode(F.concat(F.sequence(F.col("before") - HALO, F.col("before") - 1), F.sequence(after, after + HALO - 1))).alias("k", "at"))
    inside = F.pmod(F.col("at"), 2 * F.col("n"))
    asked = asked.withColumn("place", F.when(inside < F.col("n"), inside).otherwise(2 * F.col("n") - 1 - inside))
    halos = asked.join(sent, ["peak_label", "place"]).groupBy("peak_label", "piece").agg(F.array_sort(F.collect_list(F.struct("k", "y")))["y"].alias("halo"))  # 2 HALO numbers
    kernel = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                peak, first, n, t, y, halo = (batch.column(c)[k : k + 1] for c in range(6))
                size, y = len(t.flatten()), y.flatten().to_numpy(zero_copy_only=False)
                halo, total = halo.flatten().to_numpy(zero_copy_only=False), n[0].as_py()
                s = np.convolve(np.concatenate([halo[:HALO], y, halo[HALO:]]), kernel, mode="valid") if total >= LEAST_SMOOTHED else y
                place = first[0].as_py() + np.arange(size)
                yield pa.RecordBatch.from_arrays([pa.array([peak[0].as_py()] * size, pa.string()), pa.array(place), pa.array([total] * size, pa.int64()), t.flatten(), pa.array(s)], ["peak_label", "place", "n", "t", "s"])

    given = placed.join(halos, ["peak_label", "piece"]).select("peak_label", "before", "n", "t", "i", "halo")
    return given.mapInArrow(run, "peak_label string, place long, n long, t double, s double")


def rt_spans(pieces: DataFrame, expected: DataFrame) -> DataFrame:
    """H2: (peak_label, _lo, _hi, _rt) around the largest smoothed point near the expected time (peak_label, expected).

    The span ends at the nearest points on both sides that are lower than a share of the height over the base.
    """
    points = staged(smoothed_points(pieces), "smoothed")
    middle = F.avg(F.when(F.col("place").isin(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)), F.col("t")))
    whole = points.groupBy("peak_label").agg(F.max("n").alias("size"), middle.alias("middle"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))
    whole = whole.join(expected, "peak_label").withColumn("expected", F.coalesce(F.nanvl(F.col("expected"), F.lit(None).cast("double")), F.col("middle")))
    near = F.abs(F.col("t") - F.col("expected")) <= APEX_WINDOW
    best = F.struct("s", (-F.col("place")).alias("before"), "t")
    tops = points.join(whole, "peak_label").groupBy("peak_label").agg(
        F.max(F.when(near, best)).alias("near_top"), F.max(best).alias("any_top"), F.min(F.when(near, F.col("s"))).alias("near_base"), F.min("s").alias("any_base")
    )
    tops = tops.select("peak_label", F.coalesce("near_top", "any_top").alias("top"), F.coalesce("near_base", "any_base").alias("base"))
    tops = tops.select("peak_label", F.col("top.t").alias("apex"), F.col("top.s").alias("height"), (-F.col("top.before")).alias("at"), (F.col("base") + SHARE * (F.col("top.s") - F.col("base"))).alias("least"))
    low = F.col("s") < F.col("least")
    sides = points.join(tops.select("peak_label", "at", "least"), "peak_label").groupBy("peak_label").agg(
        F.max(F.when(low & (F.col("place") < F.col("at")), F.struct("place", "t"))).alias("left"), F.min(F.when(low & (F.col("place") > F.col("at")), F.struct("place", "t"))).alias("right")
    )
    found = whole.join(tops, "peak_label").join(sides, "peak_label").withColumns({"lo": F.coalesce("left.t", "t_first"), "hi": F.coalesce("right.t", "t_last")})
    width = F.col("hi") - F.col("lo")

    def end(sign: int, own: Column) -> Column:
        grown = own + sign * (LEAST_WIDTH - width) / 2
        return F.when(width < LEAST_WIDTH, grown).when(width > MOST_WIDTH, F.col("apex") + sign * MOST_WIDTH / 2).otherwise(own)

    nothing = (F.col("size") < 3) | (F.col("height") <= 0)
    return found.select(
        "peak_label",
        F.when(nothing, F.col("expected") - LEAST_WIDTH / 2).otherwise(F.greatest(end(-1, F.col("lo")), F.col("t_first"))).alias("_lo"),
        F.when(nothing, F.col("expected") + LEAST_WIDTH / 2).otherwise(F.least(end(1, F.col("hi")), F.col("t_last"))).alias("_hi"),
        F.when(nothing, F.col("expected")).otherwise(F.col("apex")).alias("_rt"),
    )


def optimize_rt_spans(traces: DataFrame, targets: DataFrame, task_values: int | None = None) -> DataFrame:
    """H3: rt, rt_min, rt_max of the flagged targets from their combined traces; targets without traces and others stay as they are."""
    flagged = targets.filter(F.coalesce("rt_auto_adjusted", F.lit(False))).select("peak_label", F.col("rt").alias("expected"))
    own = traces.join(flagged.select("peak_label"), "peak_label", "left_semi")
    sorted_ = F.array_sort(F.zip_with("t", "k", lambda t, k: F.struct(t.alias("t"), k["k"].alias("k"), k["i"].alias("i"))))
    single = single_traces(own).filter(F.size("t") > 0).withColumn("k", F.transform("i", lambda i, k: F.struct(k.alias("k"), i.alias("i"))))
    single = single.select("peak_label", F.lit(0).alias("piece"), sorted_.alias("p")).select("peak_label", "piece", F.col("p.t").alias("t"), F.col("p.i").alias("i"))
    spans = rt_spans(staged(combined_pieces(own, "max", task_values).unionByName(single), "combined"), flagged)
    out = targets.join(spans, "peak_label", "left")
    done = F.col("_rt").isNotNull()
    return out.withColumns({"rt": F.coalesce("_rt", "rt"), "rt_min": F.coalesce("_lo", "rt_min"), "rt_max": F.coalesce("_hi", "rt_max"), "rt_auto_adjusted": F.when(done, False).otherwise(F.col("rt_auto_adjusted"))}).drop("_lo", "_hi", "_rt")
