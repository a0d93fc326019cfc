"""Operators on small tables with known answers and edge cases."""

from __future__ import annotations

import base64
import io
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionlake.functions import names as N
from ionlake.operators import analysis as A
from ionlake.operators import browse as R
from ionlake.operators import calibrate as J
from ionlake.operators import combined
from ionlake.operators import extract as E
from ionlake.operators import integrate as G
from ionlake.operators import rt as H
from ionlake.operators import sweep, tiles
from ionlake.operators import targets as T
from ionlake.operators import traces as X
from ionlake.operators.quantiles import exact_quantiles
from ionlake.sources import readers, spectra
from ionlake.sources.tables import SavedTable

TARGET = "peak_label string, mz_mean double, mz_width double, rt double, rt_min double, rt_max double, rt_unit string, ms_type string, filterLine string, peak_selection boolean, bookmark boolean"
POINT = "ms_file_label string, scan_id int, mz double, intensity double, scan_time double"


def trace(spark, t, i, label="P", file="F"):
    return spark.createDataFrame([(label, file, t, i)], "peak_label string, ms_file_label string, scan_time array<double>, intensity array<double>")


def test_integration_of_three_points(spark):
    rows = trace(spark, [0.0, 1.0, 2.0], [1.0, 2.0, 3.0]).withColumn("mz_arr", F.array(F.lit(100.0), F.lit(101.0), F.lit(102.0)))
    out = G.peak_metrics(rows, F.lit(0.0), F.lit(2.0)).first()
    assert (out["peak_area"], out["peak_max"], out["peak_mz_of_max"], out["peak_n_datapoints"], out["peak_area_top3"], out["peak_rt_of_max"]) == (4, 3, 102, 3, 5, 2)


def test_empty_window_stays_with_zeros(spark):
    for t, i in (([0.0, 1.0], [5.0, 6.0]), ([], [])):
        out = G.peak_metrics(trace(spark, t, i), F.lit(10.0), F.lit(20.0)).first()
        assert (out["peak_area"], out["peak_max"], out["peak_median"], out["peak_n_datapoints"]) == (0, 0, 0, 0)
        assert out["peak_area_top3"] is None and out["peak_rt_of_max"] is None


def test_top3_is_added_in_order_of_time(spark):
    # 10.99 + 67.49 + 3.02 is 81.49999999999999, but 10.99 + 3.02 + 67.49 is 81.5.
    out = G.peak_metrics(trace(spark, [0.0, 1.0, 2.0], [10.99, 67.49, 3.02]), F.lit(0.0), F.lit(2.0)).first()
    assert out["peak_area_top3"] == 81


@pytest.mark.parametrize(("n", "place"), [(1, 0), (2, 2), (3, 2), (4, 3), (5, 4), (6, 4), (7, 4), (8, 5), (9, 6)])
def test_median_place(spark, n, place):
    out = G.peak_metrics(trace(spark, [float(k) for k in range(n)], [float(k) for k in range(1, n + 1)]), F.lit(0.0), F.lit(99.0)).first()
    assert out["peak_median"] == place


def test_shift_by_file_name_with_dots(spark):
    rows = spark.createDataFrame([('{"File-With_Special.Chars": 0.5, "b": "bad"}', f) for f in ("File-With_Special.Chars", "b", "c")] + [("not json", "c"), (None, "c")], "j string, f string")
    assert [r[0] for r in rows.select(G.rt_shift_for_file(F.col("j"), F.col("f"))).collect()] == [0.5, 0, 0, 0, 0]


def test_extraction_of_one_point(spark):
    points = spark.createDataFrame([("S1", 1, 100.0, 10.0, 1.0), ("S1", 2, 200.0, 9.0, 2.0)], POINT)
    targets = spark.createDataFrame([("T", 100.0, 10.0, 1.0, 0.0, 2.0, "s", "ms1", None, True, False)], TARGET)
    samples = spark.createDataFrame([("S1", True, True)], "ms_file_label string, use_for_processing boolean, use_for_optimization boolean")
    out = E.extract_ms1(points, targets, E.pending_pairs(targets, samples, None), E.scan_lookup(points)).collect()
    assert len(out) == 1 and out[0]["intensity"] == [10, 1] and out[0]["mz_arr"] == [100, None] and out[0]["scan_time"] == [1, 2]
    empty = E.extract_ms1(points.limit(0), targets, E.pending_pairs(targets, samples, None), E.scan_lookup(points.limit(0)))
    assert empty.count() == 0


def test_mz_range_join_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    points = [("S", int(k), float(m), 1.0, 0.0) for k, m in enumerate(rng.uniform(50, 1000, 400))]
    targets = [(f"T{k}", float(m), float(w), None, None, None, "s", "ms1", None, True, False) for k, (m, w) in enumerate(zip(rng.uniform(50, 1000, 60), rng.choice([5, 500, 20000], 60)))]
    got = {(r["scan_id"], r["peak_label"]) for r in E.mz_range_join(spark.createDataFrame(points, POINT), spark.createDataFrame(targets, TARGET)).collect()}
    assert got == {(p[1], t[0]) for p in points for t in targets if t[1] - t[1] * t[2] / 1e6 <= p[2] <= t[1] + t[1] * t[2] / 1e6}


def test_sparsify(spark):
    kept = trace(spark, [float(k) for k in range(10)], [0.0, 0.0, 1.0, 5.0, 6.0, 1.0, 0.0, 0.0, 0.0, 0.0]).select(X.sparsify(X.pairs(), baseline=4, width=1, around=1).alias("s")).first()["s"]
    assert [p["t"] for p in kept] == [2, 3, 4, 5]
    assert trace(spark, [0.0, 1.0], [0.0, 0.0]).select(F.size(X.sparsify(X.pairs(), width=1))).first()[0] == 0
    assert trace(spark, [], []).select(F.size(X.sparsify(X.pairs()))).first()[0] == 0


def test_lttb_keeps_ends_and_extremes(spark):
    t = [float(k) for k in range(100)]
    y = [0.0] * 100
    y[40] = 9.0
    out = X.lttb(trace(spark, t, y), 10).first()
    assert len(out["scan_time"]) == 10 and out["scan_time"][0] == 0 and out["scan_time"][-1] == 99 and 9.0 in out["intensity"]
    assert len(X.lttb(trace(spark, t[:15], y[:15]), 10).first()["scan_time"]) == 15


def test_alignment(spark):
    rows = trace(spark, [4.0, 5.0, 6.0], [10.0, 50.0, 20.0], file="a").union(trace(spark, [4.0, 5.0, 6.0], [5.0, 20.0, 60.0], file="b")).union(trace(spark, [], [], file="c"))
    targets = spark.createDataFrame([("P", 4.0, 6.0)], "peak_label string, rt_min double, rt_max double")
    found = H.rt_alignment(rows, targets)
    assert {r["ms_file_label"]: r["shift"] for r in found.collect()} == {"a": 0.5, "b": -0.5, "c": 0.0}
    types = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y")], "ms_file_label string, sample_type string")
    assert {r["sample_type"]: r["shift"] for r in H.shift_by_sample_type(found, types).collect()} == {"X": 0, "Y": 0}


def spans_of(spark, traces, task_values=None):
    """(rt_min, rt_max, rt) by label of [(label, file, t, y, expected)]."""
    rows = spark.createDataFrame([(k, f, [float(x) for x in t], [float(x) for x in y]) for k, f, t, y, _ in traces], "peak_label string, ms_file_label string, scan_time array<double>, intensity array<double>")
    targets = spark.createDataFrame([(k, e, True) for k, e in {k: e for k, _, _, _, e in traces}.items()], "peak_label string, rt double, rt_auto_adjusted boolean").withColumns({"rt_min": F.lit(None).cast("double"), "rt_max": F.lit(None).cast("double")})
    return {r["peak_label"]: (r["rt_min"], r["rt_max"], r["rt"]) for r in H.optimize_rt_spans(rows, targets, task_values).collect()}


def test_rt_span(spark):
    t = np.arange(0, 60, 0.5)
    found = spans_of(spark, [
        ("peak", "f", t, np.exp(-((t - 30) ** 2) / (2 * 3.0**2)) * 1000, 30.0), ("one", "f", [1.0], [5.0], 10.0), ("flat", "f", t, np.zeros(len(t)), 10.0),
        ("wide", "f", np.arange(500.0), np.full(500, 10.0) + np.exp(-((np.arange(500.0) - 250) ** 2) / 2e4), 250.0), ("middle", "f", [3.0, 1.0, 2.0], [0.0, 0.0, 0.0], None), ("none", "f", [], [], 4.0),
    ])
    low, high, apex = found["peak"]
    assert abs(apex - 30) <= 0.5 and 20 < low < 27 and 33 < high < 40
    assert found["one"] == found["flat"] == (7.5, 12.5, 10) and found["middle"] == (-0.5, 4.5, 2.0) and found["none"] == (None, None, 4.0)
    assert found["wide"][1] - found["wide"][0] <= 120


def plain_span(t, y, expected):
    """The span of a whole trace by its definition, smoothing point by point."""
    n, w = len(t), combined.weights()
    at = lambda k: y[k % (2 * n)] if k % (2 * n) < n else y[2 * n - 1 - k % (2 * n)]
    s = np.array([sum(w[j + 8] * at(k + j) for j in range(-8, 9)) for k in range(n)]) if n > 5 else y
    near = [k for k in range(n) if abs(t[k] - expected) <= 15] or list(range(n))
    top = max(near, key=lambda k: (s[k], -k))
    least = min(s[k] for k in near)
    least += 0.1 * (s[top] - least)
    low = next((t[k] for k in range(top - 1, -1, -1) if s[k] < least), t[0])
    high = next((t[k] for k in range(top + 1, n) if s[k] < least), t[-1])
    if high - low < 5:
        low, high = (low + high) / 2 - 2.5, (low + high) / 2 + 2.5
    elif high - low > 120:
        low, high = t[top] - 60, t[top] + 60
    return max(low, t[0]), min(high, t[-1]), t[top]


def test_spans_in_pieces(spark):
    rng = np.random.default_rng(12)
    traces, wanted = [], {}
    for k, (files, n, scale) in enumerate([(3, 40, 60), (4, 200, 900), (2, 3, 30), (5, 60, 20), (3, 12, 4000)]):
        own = []
        for f in range(files):
            # Most times of a peak lie close together.
            t = np.unique(np.round(np.concatenate([rng.uniform(0, scale, n // 4 + 1), rng.uniform(scale * 0.4, scale * 0.45, n)]), 3))
            own.append((t, rng.uniform(0, 5, len(t)) + 100 * np.exp(-((t - scale * 0.42) ** 2) / (2 * (scale / 30) ** 2))))
            traces.append((f"p{k}", None if f == 0 else f"f{f}", *own[-1], scale * 0.5))
        grid = np.unique(np.concatenate([t for t, _ in own]))
        wanted[f"p{k}"] = plain_span(grid, np.array([np.interp(grid, t, y, left=0, right=0) for t, y in own]).max(0), scale * 0.5)
    for task_values in (None, 200, 37, 2):
        found = spans_of(spark, traces, task_values)
        assert all(np.allclose(found[p], wanted[p], atol=1e-9) for p in wanted), task_values
    rows = spark.createDataFrame([(p, f, t.tolist(), y.tolist()) for p, f, t, y, _ in traces], "peak_label string, ms_file_label string, scan_time array<double>, intensity array<double>")
    sizes = [len(r["t"]) for r in combined.combined_pieces(rows.filter("peak_label = 'p1'"), "max", 37).collect()]
    assert len(sizes) > 20 and max(sizes) < sum(sizes) / 4  # the dense range is many pieces


def test_combine_traces(spark):
    rows = trace(spark, [0.0, 2.0], [0.0, 4.0], file="a").union(trace(spark, [1.0, 3.0], [3.0, 1.0], file="b")).union(trace(spark, [9.0], [7.0], file="c"))
    out = H.combine_traces(rows, "max").first()
    assert out["scan_time"] == [0, 1, 2, 3, 9] and out["intensity"] == [0, 3, 4, 1, 0]


def test_fit_recovers_a_peak():
    t = np.linspace(0, 30, 120)
    true = np.array([5000.0, 14.0, 1.2, 0.8])
    ok, area, sigma, tau, asym, rt, r2 = H.fit_peak(t, H.emg(t, true), 14.0)
    assert ok and r2 > 0.999 and abs(rt - 14) < 0.2 and abs(sigma - 1.2) < 0.2 and abs(area - np.trapezoid(H.emg(t, true), t)) < 20
    assert H.fit_peak(t[:4], np.ones(4), None)[0] is False
    assert H.fit_peak(t, np.zeros(len(t)), 3.0)[0] is False


def plain_fit(t, y, expected):
    """One trace by the same method with numeric derivatives and the library's own error function."""

    def model(p):
        a, mu, sigma, rate = p
        out = []
        for x in t:
            z = (mu + rate * sigma * sigma - x) / (math.sqrt(2) * sigma)
            e = rate / 2 * (2 * mu + rate * sigma * sigma - 2 * x)
            out.append(a * rate / 2 * math.exp(min(e, 700)) * math.erfc(z) if e < 700 and z < 26 else 0.0)
        return np.array(out)

    low, high = np.array([0, t.min(), 0.01, 0.1]), np.array([1e12, t.max(), 50.0, 20.0])
    p = np.clip(np.array([y.max() * 2, expected or t[y.argmax()], (t[-1] - t[0]) / 10, 1.0]), low, high)
    unit = np.array([y.max(), t[-1] - t[0], t[-1] - t[0], 1.0])
    damping, cost = 1e-2, ((y - model(p)) ** 2).sum()
    for _ in range(200):
        f = model(p)
        j = np.stack([(model(np.where(np.arange(4) == k, p + 1e-6 * unit, p)) - f) / 1e-6 for k in range(4)], axis=1)
        step = np.linalg.solve(j.T @ j + damping * np.diag(np.maximum(np.diag(j.T @ j), 1e-12)), j.T @ (y - f))
        q = np.clip(p + step * unit, low, high)
        new = ((y - model(q)) ** 2).sum()
        p, cost, damping = (q, new, damping / 5) if new < cost else (p, cost, damping * 4)
        if damping > 1e8:
            break
    return 1 - cost / ((y - y.mean()) ** 2).sum()


def test_fits_together_are_as_good_as_one_by_one():
    rng = np.random.default_rng(11)
    traces = []
    for k in range(60):
        t = np.sort(rng.uniform(0, 40, int(rng.integers(5, 60))))
        y = H.emg(t, np.array([rng.uniform(100, 1e6), rng.uniform(8, 30), rng.uniform(0.5, 4), rng.uniform(0.2, 3)])) + rng.uniform(0, 5, len(t)) * (k % 3)
        traces.append((t, y, None if k % 2 else float(t[y.argmax()])))
    together = H.fit_peaks(traces)
    for k, (t, y, e) in enumerate(traces):
        assert np.allclose(together[k][1:], H.fit_peak(t, y, e)[1:], rtol=1e-6, atol=1e-9), k
        assert together[k][6] >= plain_fit(t, y, e) - 1e-3, k


def test_combined_traces_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(4)
    own = {f"f{k:02d}": (np.sort(rng.uniform(0, 50, n)), rng.normal(5, 10, n)) for k, n in enumerate([1, 2, 7, 30, 30, 12])}
    schema = "peak_label string, ms_file_label string, scan_time array<double>, intensity array<double>"
    rows = spark.createDataFrame([("P", f, t.tolist(), y.tolist()) for f, (t, y) in own.items()] + [("one", "f", [3.0, 1.0], [1.0, 2.0]), ("bare", "f", [1.0], [2.0]), ("bare", "g", [2.0], [2.0])], schema)
    grid = np.unique(np.concatenate([t for t, _ in own.values()]))
    values = np.array([np.interp(grid, t, y, left=0, right=0) for t, y in own.values() if len(t) > 1])
    for values_a_task in (combined.TASK_VALUES, 60):
        monkeypatch.setattr(combined, "TASK_VALUES", values_a_task)
        for method, wanted in (("max", values.max(0)), ("mean", values.mean(0)), ("median", np.median(values, 0))):
            got = {r["peak_label"]: r for r in H.combine_traces(rows, method).collect()}
            assert np.allclose(got["P"]["scan_time"], grid) and np.allclose(got["P"]["intensity"], wanted), method
            assert got["one"]["scan_time"] == [3.0, 1.0] and got["bare"]["scan_time"] == []


@pytest.mark.parametrize("method", ["max", "mean"])
def test_long_segments_are_not_sent_to_each_piece(spark, method):
    # Half of the traces have two points and reach across all; some are the same, and times come twice.
    rng = np.random.default_rng(7)
    own = {f"f{k:03d}": (np.sort(np.round(rng.uniform(0, 100, n), 1)), np.round(rng.normal(5, 10, n), 1)) for k, n in enumerate([2, 30] * 100)}
    own = {f: (t + 1e-4 * np.arange(len(t)), y) for f, (t, y) in own.items()} | {f"g{k}": (np.array([-1.0, 101.0]), np.array([3.0, 4.0])) for k in range(40)}
    rows = spark.createDataFrame([("P", f, t.tolist(), y.tolist()) for f, (t, y) in own.items()], "peak_label string, ms_file_label string, scan_time array<double>, intensity array<double>").coalesce(1)
    pieces = combined.combined_pieces(rows, method, 20).orderBy("piece").collect()
    grid = np.unique(np.concatenate([t for t, _ in own.values()]))
    values = np.array([np.interp(grid, t, y, left=0, right=0) for t, y in own.values()])
    assert len(pieces) > 100 and np.array_equal(np.concatenate([r["t"] for r in pieces]), grid)
    assert np.allclose(np.concatenate([r["i"] for r in pieces]), values.max(0) if method == "max" else values.mean(0))
    inner = np.linspace(0, 100, 201)[1:-1]
    given = [{"peak_label": "P", "usable": len(own), "cuts": inner, "t": t, "i": y} for t, y in own.values()]
    dealt = combined._deal_lines(method)(iter([combined.pd.DataFrame(given)]))
    assert sum(len(x) for x in dealt) < 2 * sum(len(t) for t, _ in own.values()) + 10 * len(inner)  # 140 traces cross up to 200 pieces each


@pytest.mark.parametrize("file_rows", [1, 5, 1 << 18])
def test_filled_windows_are_the_joined_rows(spark, monkeypatch, file_rows):
    monkeypatch.setattr(E, "FILE_ROWS", file_rows)
    rng = np.random.default_rng(8)
    scans = [(f"f{f}", int(k) if k else None, float(k // 2)) for f in range(4) for k in rng.permutation(60)] + [("f0", 7, 3.0), ("f0", 7, 40.0), ("f0", 8, None), (None, 1, 1.0)]
    scans = spark.createDataFrame(scans, "ms_file_label string, scan_id int, scan_time double")
    pairs = [(f"P{p}", f"f{f}", float(3 * p), float(3 * p + 9)) for p in range(6) for f in range(6)] + [("P1", "f1", 20.0, 25.0), ("P1", "f1", 5.0, 8.0), ("P9", "f2", None, None), ("P8", "f2", 9.0, 1.0), ("P7", "f2", 900.0, 950.0), (None, "f1", 1.0, 2.0), ("P1", None, 1.0, 2.0)]
    pairs = spark.createDataFrame(pairs, "peak_label string, ms_file_label string, rt_min double, rt_max double")
    matched = {(f"P{p}", f"f{f}", int(k)): (float(rng.integers(1, 99)) + 0.25, float(k)) for p in range(7) for f in range(5) for k in rng.integers(0, 70, 15)}
    matched = spark.createDataFrame([(*k, *v) for k, v in matched.items()] + [("P1", "f1", None, 5.0, 6.0), ("P2", "f1", 9000, None, 6.0)], "peak_label string, ms_file_label string, scan_id int, intensity double, mz double")
    plain = X.ordered_lists(E.fill_missing_scans(E.rt_range_join(pairs, scans, 2.0), matched), E.PAIR, ["scan_time", "scan_id"], ["scan_time", "intensity", "mz"])
    found = E.filled_windows(pairs, scans, matched, 2.0)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and found.count() == 26
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each scan of each pair
    assert E.filled_windows(pairs.limit(0), scans, matched).count() == 0 and E.filled_windows(pairs, scans.limit(0), matched).count() == 0


def test_filled_lists_are_the_joined_rows(spark):
    pairs = spark.createDataFrame([("A", "f"), ("B", "f"), ("B", "f"), ("A", "g"), ("A", "none")], "peak_label string, ms_file_label string")
    scans = spark.createDataFrame([("f", k % 40, float(k % 40 * 7 % 11)) for k in range(60)] + [("g", 3, 1.0), ("g", 3, 2.0)], "ms_file_label string, scan_id int, scan_time double")
    matched = spark.createDataFrame([("A", "f", 5, 2.5, 100.0), ("A", "f", 39, None, 101.0), ("B", "f", 0, 3.4, 102.0), ("A", "g", 3, 8.0, 103.0), ("C", "f", 1, 9.0, 104.0)], "peak_label string, ms_file_label string, scan_id int, intensity double, mz double")
    plain = X.ordered_lists(E.fill_missing_scans(pairs.join(scans.distinct(), "ms_file_label"), matched), E.PAIR, ["scan_time", "scan_id"], ["scan_time", "intensity", "mz"])
    found = E.filled_lists(pairs, scans, matched)
    assert sorted(found.collect()) == sorted(plain.select(found.columns).collect()) and found.count() == 3
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_full_range_of_pending_pairs(spark):
    points = spark.createDataFrame([("S1", k, 100.0, float(k), float(k)) for k in range(3000)] + [("S2", 1, 300.0, 1.0, 1.0)], POINT)
    targets = spark.createDataFrame([("T", 100.0, 10.0, 1.0, 0.0, 2.0, "s", "ms1", None, True, False), ("U", None, 10.0, 1.0, 0.0, 2.0, "s", "ms1", None, True, False)], TARGET)
    have = spark.createDataFrame([("T", "S1", "ms1", None), ("T", "S2", "ms1", [1.0]), ("U", "S1", "ms1", None), ("T", "S1", "ms2", None)], "peak_label string, ms_file_label string, ms_type string, scan_time_full_ds array<double>")
    pairs = E.pending_full_range(have, targets)
    out = E.extract_full_range(points, targets, pairs, E.scan_lookup(points)).collect()
    assert [(r["peak_label"], r["ms_file_label"], len(r["scan_time_full_ds"]), r["scan_time_full_ds"][-1]) for r in out] == [("T", "S1", 1000, 2999.0)]


def test_rt_range_join_equals_all_pairs(spark):
    rng = np.random.default_rng(6)
    schema = "peak_label string, ms_file_label string, rt_min double, rt_max double"
    pairs = [(f"P{k}", f"F{k % 3}", float(a), float(a + w)) for k, (a, w) in enumerate(zip(rng.uniform(-200, 5000, 60), rng.choice([0, 50, 500, 5000], 60)))] + [("N", "F0", None, None), ("X", "F1", 9.0, -90.0)]
    scans = [(f"F{k % 3}", k, float(t)) for k, t in enumerate(rng.uniform(-100, 6000, 400))]
    got = {(r["peak_label"], r["scan_id"]) for r in E.rt_range_join(spark.createDataFrame(pairs, schema), spark.createDataFrame(scans, "ms_file_label string, scan_id int, scan_time double")).collect()}
    assert got == {(p, s) for p, f, a, b in pairs for g, s, t in scans if f == g and (a or 0) - 30 <= t <= (999999.0 if b is None else b) + 30}


def test_preview_of_ms2_and_line_plots(spark):
    rows = trace(spark, [float(k) for k in range(10)], [0.0, 0.0, 12.0, 50.0, 60.0, 12.0, 0.0, 0.0, 0.0, 0.0], file="a")
    targets = spark.createDataFrame([("P", 2.0, 6.0)], "peak_label string, rt_min double, rt_max double")
    samples = spark.createDataFrame([("a", "X")], "ms_file_label string, sample_type string")
    shown = X.preview_traces(rows, targets, samples, ms_type="ms2").first()
    assert shown["top"] == 60 and shown["least_positive"] == 12 and 2.0 in shown["scan_time"] and 9.0 not in shown["scan_time"]
    made = X.build_traces(rows, F.lit(0.5), baseline=4.0).first()
    assert made["scan_time"][0] >= 1.5 and 60.0 in made["intensity"]


def test_envelope_of_full_range_and_types(spark):
    schema = "peak_label string, ms_file_label string, ms_type string, scan_time array<double>, intensity array<double>, scan_time_full_ds array<double>, intensity_full_ds array<double>"
    rows = spark.createDataFrame([("P", "a", "ms1", [1.0, 2.0], [5.0, 6.0], [0.0, 9.0], [1.0, 2.0]), ("Q", "a", "ms1", [1.0], [7.0], None, None), ("Q", "a", "ms2", [1.0], [8.0], None, None)], schema)
    targets = spark.createDataFrame([("P", 0.0), ("Q", 0.0)], "peak_label string, intensity_threshold double")
    samples = spark.createDataFrame([("a", "X", "#1", True), ("b", "X", "#1", False)], "ms_file_label string, sample_type string, color string, use_for_optimization boolean")
    top = lambda **how: {r["peak_label"]: r["m"] for r in H.envelope(rows, targets, samples, 10, **how).groupBy("peak_label").agg(F.max("max_int").alias("m")).collect()}
    assert top(ms_type="ms1") == {"P": 6, "Q": 7} and top(ms_type="ms2") == {"P": 6, "Q": 8} and top(ms_type="ms1", full_range=True) == {"P": 2}


def test_matrix_components_and_distances(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(100, [5, 1, 20], (30, 3))
    rows = spark.createDataFrame([(f"f{i:02d}", "abc"[j], float(m[i, j])) for i in range(30) for j in range(3) if (i, j) != (4, 1)], "ms_file_label string, peak_label string, v double")
    m[4, 1] = 0
    scores, parts, loadings = A.matrix_pca(rows, "v", ["a", "b", "c"])
    x = m - m.mean(0)
    s = np.linalg.svd(x, compute_uv=False)
    got = np.array([r["scores"] for r in scores.orderBy("ms_file_label").collect()])
    assert np.allclose(np.linalg.norm(got, axis=0), s) and np.allclose([r["cumulative"] for r in parts.orderBy("component").collect()], np.cumsum(s**2 / (s**2).sum()))
    assert [r["place"] for r in loadings.collect()] == [1, 2, 3] and {r["peak_label"] for r in loadings.collect()} == {"a", "b", "c"}
    vectors = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(m)], "id long, v array<double>")
    exact, wide = (A.pca(vectors, "id", "v", 2, covariance_width=w) for w in (1000, 2))  # beyond the width: without the covariance
    assert np.allclose(exact[1], wide[1]) and np.allclose(exact[2], wide[2])
    far = {(r["a"], r["b"]): r["distance"] for r in A.sample_distances(rows, "ms_file_label", "peak_label", "v").collect()}
    assert len(far) == 30 * 29 // 2 and abs(far["f03", "f04"] - np.linalg.norm(m[3] - m[4])) < 1e-6
    apart = spark.createDataFrame([("x", "k1", 3.0), ("y", "k2", 4.0)], "a string, along string, v double")
    assert A.sample_distances(apart, "a", "along", "v").first()["distance"] == 5


def test_shifts_as_map_json_and_rows(spark):
    rows = trace(spark, [1.0, 2.0, 3.0], [1.0, 5.0, 9.0], file="a").union(trace(spark, [1.0, 2.0, 3.0], [1.0, 5.0, 9.0], file="b"))
    base = spark.createDataFrame([("P", 1.0, 2.0, True)], "peak_label string, rt_min double, rt_max double, rt_align_enabled boolean")
    as_json = base.withColumn("rt_align_shifts", F.lit('{"a": -1.0, "b": "bad"}'))
    as_map = base.withColumn("rt_align_shifts", F.create_map(F.lit("a"), F.lit(-1.0)))
    as_rows = spark.createDataFrame([("P", "a", -1.0)], "peak_label string, ms_file_label string, shift double")
    for out in (G.integrate(rows, as_json), G.integrate(rows, as_map), G.integrate(rows, base, as_rows)):
        assert {r["ms_file_label"]: (r["rt_shift"], r["peak_max"], r["rt_aligned"]) for r in out.collect()} == {"a": (-1.0, 9.0, True), "b": (0.0, 5.0, True)}


@pytest.mark.parametrize(("mode", "y", "slope", "intercept"), [(J.FIXED, [3.0, 4.0, 5.0], 1, 2), (J.FREE, [3.0, 5.0, 7.0], 2, 1), (J.BOUNDED, [4.0, 7.0, 10.0], 2, 3)])
def test_linear_fits(spark, mode, y, slope, intercept):
    point = F.array(*[F.struct(F.lit(b).alias("y"), F.lit(a).alias("x")) for a, b in zip([1.0, 2.0, 3.0], y)])
    f = spark.range(1).select(J.fit(point, mode, (0.5, 2.0)).alias("f")).first()["f"]
    assert abs(f["slope"] - slope) < 1e-9 and abs(f["intercept"] - intercept) < 1e-9


def test_linear_range_and_prediction(spark):
    point = sorted(zip([10.0, 3.0, 4.0, 5.0, 20.0], [1.0, 2.0, 3.0, 4.0, 5.0]))
    col = F.array(*[F.struct(F.lit(b).alias("y"), F.lit(a).alias("x")) for b, a in point])
    r = spark.range(1).select(J.linear_range(col, J.FIXED).alias("r")).first()["r"]
    assert [p["x"] for p in r["points"]] == [2, 3, 4] and abs(r["fit"]["intercept"] - 1) < 1e-9
    train = spark.createDataFrame([("A", float(v), float(c)) for v, c in zip([10, 100, 1000], [1, 10, 100])] + [("Q", 1.0, 1.0)], "peak_label string, value double, std_conc double")
    curves = J.calibration_curves(train)
    values = spark.createDataFrame([("A", 500.0), ("A", None), ("Z", 1.0)], "peak_label string, value double")
    got = {(r["peak_label"], r["value"]): (r["pred_conc"], r["in_range"]) for r in J.predict_concentration(values, curves).collect()}
    assert abs(got["A", 500.0][0] - 50) < 1e-6 and got["A", 500.0][1] == 1 and got["A", None][1] == 0 and got["Z", 1.0] == (None, None)
    assert curves.filter("peak_label = 'Q'").first()["intercept"] == 0


def test_target_rules(spark):
    rows = spark.createDataFrame(
        [("a", 100.0, None, None, "s"), ("b", None, 10.0, 20.0, "s"), ("c", None, 5.0, None, "s"), ("d", 2.0, None, None, "s"), ("", 50.0, 40.0, 60.0, "s"), ("e", 1.0, 10.0, 20.0, "min"), ("f", 50.0, None, 52.0, "s"), ("g", 50.0, 40.0, 60.0, "hours")],
        "peak_label string, rt double, rt_min double, rt_max double, rt_unit string",
    )
    got = {r["peak_label"]: r for r in T.recenter_rt(T.validate_targets(T.rt_to_seconds_unit(T.derive_rt_window(rows)))).collect()}
    assert (got["a"]["rt_min"], got["a"]["rt_max"], got["a"]["rt_auto_adjusted"]) == (95, 105, True)
    assert (got["b"]["rt"], got["b"]["rt_auto_adjusted"]) == (15, False)
    assert got["c"]["error"] and got["d"]["error"] == "negative rt_min" and got[""]["error"] == "empty label" and got["g"]["error"] == "unknown unit"
    assert (got["e"]["rt"], got["e"]["rt_auto_adjusted"], got["f"]["rt_min"]) == (900, True, 48)


def test_sorts_and_filters(spark):
    rows = spark.createDataFrame([("b", 1, 1), (None, 2, 2), ("A", None, 3)], "name string, value int, id int")
    assert [r["id"] for r in rows.orderBy(*R.sort_keys(rows, [("name", "ascend")], "id")).collect()] == [3, 1, 2]
    assert [r["id"] for r in rows.orderBy(*R.sort_keys(rows, [("value", "descend"), ("none", "ascend")], "id")).collect()] == [3, 2, 1]
    assert R.sort_keys(rows, [("none", "ascend")], "id") == []
    odd = spark.createDataFrame([("50%_x",), ("50ab",)], "name string")
    assert R.keyword_filter(odd, {"name": "0%_"}).count() == 1 and R.keyword_filter(odd, {"name": ""}, {"name": []}).count() == 2


def test_quota_sample(spark):
    rows = spark.createDataFrame([("A", f"a{k}") for k in range(4)] + [("B", f"b{k}") for k in range(2)], "g string, k string")
    assert R.quota_sample(rows, "g", "k", 3).count() == 3 and R.quota_sample(rows, "g", "k", 6).count() == 6


def test_durations(spark):
    texts = ["PT1M30S", "12.5", "PT2H", "pt1.5s", "", None, "soon"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(N.rt_to_seconds(F.col("t"))).collect()] == [90, 12.5, 7200, 1.5, 0, 0, 0]
    assert [spectra.seconds(t) for t in texts] == [90, 12.5, 7200, 1.5, 0, 0, 0]


def test_column_names():
    assert N.renames(["compoundId", "compound", "medMz", "medRt", "parent"]) == {"medMz": "mz_mean", "compound": "peak_label", "medRt": "rt"}
    assert N.renames(["peak_label", "name", "mz_mean", "parent"]) == {}


def test_normalisation_and_pca(spark):
    rows = spark.createDataFrame([("f1", "p", 1.0), ("f2", "p", 3.0), ("f1", "q", 5.0), ("f2", "q", 5.0)], "ms_file_label string, peak_label string, v double")
    assert {(r["ms_file_label"], r["peak_label"]): r["z"] for r in A.zscore(rows, "v").collect()} == {("f1", "p"): -1, ("f2", "p"): 1, ("f1", "q"): 0, ("f2", "q"): 0}
    assert abs(rows.select(A.rocke_durbin(F.lit(0.0))).first()[0] - math.log(5)) < 1e-12
    x = np.random.default_rng(3).normal(size=(40, 3)) @ np.diag([3.0, 1.0, 0.2])
    frame = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, v array<double>")
    scores, loadings, ratio = A.pca(frame, "id", "v", 3)
    got = np.array([r["scores"] for r in scores.orderBy("id").collect()])
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(ratio, s**2 / (s**2).sum()) and np.allclose(np.abs(got).max(), np.abs(got[:, 0]).max()) and loadings.shape == (3, 3)


def test_p_values():
    # Known values: t = 2.0 with 10 degrees of freedom; F = 4.0 with 2 and 12.
    assert abs(A.incomplete_beta(5.0, 0.5, 10 / 14.0) - 0.07338803) < 1e-6
    assert abs(A.incomplete_beta(6.0, 1.0, 12 / (12 + 8.0)) - 0.6**6) < 1e-9


def test_small_files_from_their_tree_are_as_from_events():
    part = lambda kind, values: f'<binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="{kind}"/><binary>{base64.b64encode(np.array(values, "<f8").tobytes()).decode()}</binary></binaryDataArray>'
    scan = lambda k, n: f'<spectrum index="{k}" id="scan={k}"><cvParam accession="MS:1000511" value="2"/><cvParam accession="MS:1000512" value="f{k}"/><cvParam accession="MS:1000016" value="{k}" unitName="minute"/>{part("MS:1000514", range(n))}{part("MS:1000515", range(n))}</spectrum>'
    text = f'<mzML xmlns="x"><run startTimeStamp="T"><spectrumList>{scan(3, 2)}{scan(4, 0)}{scan(5, 1)}</spectrumList></run></mzML>'.encode()
    said = lambda rows: [{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in r.items()} for r in rows]
    assert said(spectra.tree_scans(text)) == said(spectra.scans(spectra.ET.iterparse(io.BytesIO(text), events=("start", "end"))))
    assert [b.num_rows for b in spectra.points_of("f.mzML", pa.BufferReader(text))] == [3]
    assert spectra.points_of("f.mzML", pa.BufferReader(text[:-20]))[0].to_pylist()[0]["error"].startswith("Invalid XML")


def test_points_of_many_files_are_few_parquet_files(spark, tmp_path):
    rows = spark.range(6000).select(F.concat(F.lit("F"), F.col("id") % 2000).alias("ms_file_label"), (F.col("id") % 7).cast("int").alias("scan_id"), F.col("id").cast("double").alias("mz"), F.lit(1.0).alias("intensity"), F.lit(2.0).alias("scan_time"))
    readers.write_points(rows, str(tmp_path / "p"))
    assert len(list((tmp_path / "p").rglob("*.parquet"))) <= 8
    found = readers.read_points(spark, str(tmp_path / "p"))
    assert sorted(found.select(rows.columns).collect()) == sorted(rows.collect())


def test_spectra_files(spark, tmp_path):
    def b64(values, kind):
        return base64.b64encode(np.array(values, kind).tobytes()).decode()

    def array(values, accession):
        return f'<binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="{accession}"/><binary>{b64(values, "<f8")}</binary></binaryDataArray>'

    spectrum = f'<spectrum index="0" id="scan=7"><cvParam accession="MS:1000511" value="1"/><cvParam accession="MS:1000130"/><scanList><scan><cvParam accession="MS:1000016" value="1.5" unitName="minute"/></scan></scanList><binaryDataArrayList>{array([100.5, 101.5], "MS:1000514")}{array([10, 20], "MS:1000515")}</binaryDataArrayList></spectrum>'
    (tmp_path / "a.mzML").write_text(f'<mzML xmlns="http://psi.hupo.org/ms/mzml"><run startTimeStamp="2024-01-01"><spectrumList><spectrum index="1" id="scan=8"/>{spectrum}</spectrumList></run></mzML>')
    pairs = b64([100.5, 10, 101.5, 20], ">f8")
    (tmp_path / "b.mzXML").write_text(f'<mzXML><msRun><scan num="7" msLevel="2" polarity="+" retentionTime="PT90S" filterLine="x"><precursorMz>55.5</precursorMz><peaks precision="64">{pairs}</peaks></scan></msRun></mzXML>')
    (tmp_path / "c.mzML").write_text("<mzML><run>")
    out = spectra.ingest_spectra(spark, str(tmp_path))
    rows = {r["ms_file_label"]: [] for r in out.collect()}
    for r in out.collect():
        rows[r["ms_file_label"]].append((r["scan_id"], r["mz"], r["intensity"], r["scan_time"]))
    assert sorted(rows["a"]) == sorted(rows["b"]) == [(7, 100.5, 10, 90), (7, 101.5, 20, 90)]
    assert [r["ms_file_label"] for r in spectra.ingest_errors(out).collect()] == ["c"]
    assert out.filter("ms_file_label = 'b'").first()["filterLine_ELMAVEN"] == "Positive 55.500 [100.500]"


def test_nested_scans_and_streamed_files(spark, tmp_path):
    def peaks(values):
        return f'<peaks precision="64">{base64.b64encode(np.array(values, ">f8").tobytes()).decode()}</peaks>'

    inner = "".join(f'<scan num="{k}" msLevel="2" polarity="-" retentionTime="PT{k}S" filterLine="f{k}"><precursorMz>50</precursorMz>{peaks([10.0 * k, k])}</scan>' for k in (2, 3))
    (tmp_path / "n.mzXML").write_text(f'<mzXML><msRun><scan num="1" msLevel="1" polarity="+" retentionTime="PT1S">{peaks([100.0, 1, 200.0, 2])}{inner}</scan><scan num="4" msLevel="1" polarity="+" retentionTime="PT4S">{peaks([400.0, 4])}</scan></msRun></mzXML>')
    with open(tmp_path / "n.mzXML", "rb") as f:
        assert [s["id"] for s in spectra.scans(spectra.ET.iterparse(f, events=("start", "end")))] == [1, 2, 3, 4]
    for whole in (spectra.WHOLE_BYTES, 0):
        rows = spectra.ingest_spectra(spark, str(tmp_path), whole).collect()
        assert sorted((r["scan_id"], r["mz"]) for r in rows) == [(1, 100.0), (1, 200.0), (2, 20.0), (3, 30.0), (4, 400.0)]
        assert {r["ms_level"] for r in rows} == {1} and {r["polarity"] for r in rows} == {"Positive"}


def test_sweep_is_the_range_join(spark, monkeypatch):
    rng = np.random.default_rng(6)
    mz = [100.0] * 4000 + [float(x) for x in np.round(rng.uniform(50, 1000, 6000), 2)] + [None, float("nan"), float("inf"), -5.0]
    points = spark.createDataFrame([(f"f{k % 7}", k % 97, m, float(k), None, float(k)) for k, m in enumerate(mz)], "ms_file_label string, scan_id int, mz double, intensity double, _value string, _low double")
    windows = [(f"p{k}", float(rng.uniform(50, 1000)), float(rng.choice([10, 5000, 400_000]))) for k in range(60)] + [("hot", 100.0, 10.0), ("hot", 100.0, 20.0), ("ends", 200.0, 1e6), ("none", None, 10.0), ("less", 100.0, -1.0), ("point", 100.0, 0.0)]
    targets = spark.createDataFrame(windows, "peak_label string, mz_mean double, mz_width double")
    key = lambda df: sorted(map(str, df.select("peak_label", "ms_file_label", "scan_id", "mz", "intensity").collect()))
    wanted = sorted(str(r) for r in points.join(targets, F.col("mz").between(*E.mz_bounds())).select("peak_label", "ms_file_label", "scan_id", "mz", "intensity").collect())
    assert key(E.mz_range_join(points.drop("_low", "_value").filter("mz > 0 AND mz < 1e9"), targets)) == wanted
    for batch in (1 << 17, 50):
        monkeypatch.setattr(sweep, "BATCH_ROWS", batch)
        assert key(E.mz_sweep_join(points, targets)) == wanted
    assert E.mz_sweep_join(points.limit(0), targets).count() == E.mz_sweep_join(points, targets.limit(0)).count() == 0
    # The common ion is in several partitions.
    dealt = points.filter("mz IS NOT NULL").repartitionByRange(8, F.col("mz"), F.xxhash64("ms_file_label", "scan_id", "intensity"))
    assert dealt.filter("mz = 100").select(F.spark_partition_id()).distinct().count() > 2
    monkeypatch.setattr(E, "FEW_WINDOWS", 3)
    assert key(E.mz_join(points, targets)) == wanted


def test_missing_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    labels = [*[f"t{k}" for k in range(300)], "t1", None]
    targets = spark.createDataFrame([(t, k, "ms1" if k % 2 else "ms2", True, None, float(k), float(k + 1), "min", False) for k, t in enumerate(labels)], "peak_label string, n int, ms_type string, peak_selection boolean, filterLine string, rt_min double, rt_max double, rt_unit string, bookmark boolean")
    samples = spark.createDataFrame([(f"f{k}", True) for k in range(9)] + [("f1", True), ("f9", False)], "ms_file_label string, use_for_processing boolean")
    have = spark.createDataFrame([(f"t{rng.integers(320)}", f"f{rng.integers(11)}", str(rng.choice(["ms1", "ms2"]))) for _ in range(900)] + [(None, "f1", "ms1")], "peak_label string, ms_file_label string, ms_type string")
    grid = E.pair_grid(targets, samples.filter("use_for_processing"))
    wanted = grid.join(have.distinct(), ["peak_label", "ms_file_label", "ms_type"], "left_anti")
    key = lambda df: sorted(map(str, df.select("peak_label", "ms_file_label", "n", "rt_min", "rt_max").collect()))
    for blocks in (16, 1):
        monkeypatch.setattr(E, "BLOCKS", blocks)
        assert key(E.pending_pairs(targets, samples, have)) == key(wanted)
        assert "Cartesian" not in (plan := E.pending_pairs(targets, samples, have)._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    counts = {r["ms_type"]: (r["n_pairs"], r["n_existing"], r["n_missing"]) for r in E.pair_counts(targets, samples, have).collect()}
    all_, found = E.pair_grid(targets, samples), have.distinct()
    for kind, (n, existing, missing) in counts.items():
        assert n == all_.filter(F.col("ms_type") == kind).count() and existing + missing == n
        assert existing == all_.join(found, ["peak_label", "ms_file_label", "ms_type"], "left_semi").filter(F.col("ms_type") == kind).count()
    assert E.pending_pairs(targets, samples.limit(0), have).count() == E.pending_pairs(targets.limit(0), samples, have).count() == 0
    assert E.pending_pairs(targets, samples, have.limit(0)).count() == grid.count()
    # More targets than one bitmap has bits.
    many = spark.range(40_000).select(F.concat(F.lit("m"), "id").alias("peak_label"), F.lit("ms1").alias("ms_type"), F.lit(True).alias("peak_selection"), F.lit(0.0).alias("rt_min"), F.lit(1.0).alias("rt_max"), F.lit("s").alias("rt_unit"))
    done = many.filter("hash(peak_label) % 3 <> 0").select("peak_label", F.lit("f1").alias("ms_file_label"), "ms_type")
    left = E.missing_pairs(many, samples.filter("ms_file_label = 'f2' OR ms_file_label = 'f1'").distinct(), done)
    assert left.filter("ms_file_label = 'f2'").distinct().count() == 40_000
    assert left.filter("ms_file_label = 'f1'").join(done, "peak_label", "left_semi").count() == 0 and left.count() == 80_000 - done.count()


def _array(values, accession):
    return f'<binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="{accession}"/><binary>{base64.b64encode(np.array(values, "<f8").tobytes()).decode()}</binary></binaryDataArray>'


def _mzml(scans, level=1):
    parts = [f'<spectrum index="{k}" id="scan={k}"><cvParam accession="MS:1000511" value="{level}"/><scanList count="1"><scan ><cvParam accession="MS:1000016" value="{k}.5"/></scan></scanList><precursorList><cvParam accession="MS:1000744" value="77.25"/></precursorList>{_array([k + 0.25] * (k % 4), "MS:1000514")}{_array([k] * (k % 4), "MS:1000515")}</spectrum>\n' for k in range(scans)]
    return f'<?xml version="1.0" encoding="ISO-8859-1"?>\n<indexedmzML xmlns="http://psi.hupo.org/ms/mzml"><mzML><run startTimeStamp="2024-01-01"><spectrumList>{"".join(parts)}</spectrumList><chromatogramList><chromatogram/></chromatogramList></run></mzML><indexListOffset>1</indexListOffset></indexedmzML>'


def _mzxml(scans):
    def one(k, inside=""):
        pairs = base64.b64encode(np.array([k + 0.5, k] * (k % 3), ">f8").tobytes()).decode()
        peaks = f'<peaks precision="64">{pairs}</peaks>'
        return f'<scan num="{k}" msLevel="{2 if k % 4 else 1}" polarity="+" retentionTime="PT{k}S"><precursorMz>50</precursorMz>{inside + peaks if k % 8 == 4 else peaks + inside}</scan>\n'

    parts = [one(k, "".join(one(k + j, one(k + j + 100) if j == 2 else "") for j in (1, 2, 3))) for k in range(0, scans, 4)]
    return f'<mzXML xmlns:x="x"><msRun>{"".join(parts)}<scan num="999" x:y="1"/></msRun><index name="scan"><offset id="1">10</offset></index></mzXML>'


def _in_ranges(text, size, path="f.mzML"):
    """(points, errors) of ranges of ``size`` bytes, by the rules of commits()."""
    data, rows, left, errors = text.encode(), [], 0, []
    for start in range(0, max(1, len(data)), size):
        for r in spectra.range_of(path, pa.BufferReader(data), start, start + size):
            if r.get("error"):
                errors.append(r["error"])
            elif "scan_id" in r:
                rows += [(r["scan_id"], r["scan_time"], m, i) for m, i in zip(r["mz"], r["intensity"])]
            else:
                left = -(10**6) if left < r["closes"] else left - r["closes"] + r["opens"]
    return rows, errors or (["open"] if left else [])


@pytest.mark.parametrize("text", [_mzml(9), _mzxml(20), _mzml(0), _mzxml(0), _mzml(3, 2)])
def test_ranges_read_what_one_task_reads(text, monkeypatch):
    whole = [(s["id"], s["time"], m, i) for s in spectra.scans(spectra.ET.iterparse(io.BytesIO(text.encode()), events=("start", "end"))) for m, i in zip(s["mz"], s["intensity"])]
    for read in (1 << 20, 100):
        monkeypatch.setattr(spectra, "READ_BYTES", read)
        for size in (1, 7, 150, 333, 1000, 10**6):
            rows, errors = _in_ranges(text, size)
            assert not errors and sorted(rows) == sorted(whole), (size, errors)
        # Cut anywhere: an error whatever the size of the ranges.
        for cut in range(1, len(text) - 1, 17):
            assert _in_ranges(text[:cut], 400)[1], cut
    assert _in_ranges(text.replace("</scan>", "", 1), 300)[1] or "</scan>" not in text


def test_no_point_of_a_broken_file(spark, tmp_path):
    texts = {"good.mzML": _mzml(400), "cut.mzML": _mzml(400)[: int(0.9 * len(_mzml(400)))], "good2.mzXML": _mzxml(200), "cut2.mzXML": _mzxml(200)[: int(0.9 * len(_mzxml(200)))], "two.mzML": _mzml(30, 2), "base64.mzML": _mzml(30).replace("<binary>", "<binary>A", 9), "none.mzML": _mzml(0), "text.mzXML": "no xml"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="latin-1")
    read = {}
    for whole, split in ((1 << 30, 1), (0, 5000), (0, 64 << 20), (9000, 777)):
        out = spectra.ingest_spectra(spark, str(tmp_path), whole, split)
        assert sorted(r["ms_file_label"] for r in spectra.ingest_errors(out).collect()) == ["base64", "cut", "cut2", "text"]
        read[whole, split] = sorted(map(str, spectra.good_points(out).collect()))
    assert len(read[0, 5000]) > 500 and all(r == read[0, 5000] for r in read.values())
    assert {r["filterLine_ELMAVEN"] for r in spectra.good_points(out).filter("ms_file_label = 'two'").collect()} == {f"Negative 77.250 [{k}.250]" for k in range(30) if k % 4}


def test_tables(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\tb\n1\t2\n")
    (tmp_path / "u.txt").write_text("a,b\n1,2\n")
    assert readers.read_table(spark, str(tmp_path / "t.txt")).columns == readers.read_table(spark, str(tmp_path / "u.txt")).columns == ["a", "b"]
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "x.xlsx"))
    with pytest.raises(ValueError):
        readers.dense_matrix(spark.range(1), "ms_file_label", "peak_label", "secret", [])


def test_envelope(spark):
    rng = np.random.default_rng(0)
    rows, types = None, []
    for kind, base in (("A", 1000.0), ("B", 2000.0)):
        for k in range(5):
            one = trace(spark, [float(x) for x in np.linspace(0, 30, 100)], [float(base + v) for v in rng.uniform(0, 100, 100)], file=f"{kind}{k}")
            rows = one if rows is None else rows.union(one)
            types.append((f"{kind}{k}", kind, "#1"))
    samples = spark.createDataFrame(types, "ms_file_label string, sample_type string, color string")
    targets = spark.createDataFrame([("P", 0.0)], "peak_label string, intensity_threshold double")
    out = H.envelope(rows, targets, samples, bins=10).collect()
    assert len(out) <= 20 and all(r["min_int"] >= (1000 if r["sample_type"] == "A" else 2000) and r["sample_count"] == 5 for r in out)


def test_tables_change(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("b", None, "z"), ("c", 3, None)], "k string, v int, w string")
    assert {r["k"]: (r["v"], r["w"]) for r in T.update_rows(old, new, "k", ["v", "w"]).collect()} == {"a": (1, "x"), "b": (2, "z")}
    assert {r["k"]: r["v"] for r in T.upsert(old, new, ["k"]).collect()} == {"a": 1, "b": None, "c": 3}
    assert T.delete_rows({"t": old}, new, ["k"])["t"].count() == 1


@pytest.mark.parametrize(("keys", "along"), [(1024, 256), (4, 3), (1, 1)])
def test_tiles_are_all_distances(spark, keys, along):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((11, 17)) < 0.4, rng.normal(size=(11, 17)), 0)
    x[:, 0] = 1.0
    rows = spark.createDataFrame([(f"k{i:02}", f"f{j}", float(x[i, j])) for i in range(11) for j in range(17) if x[i, j]] + [("k00", "f99", None)], "k string, f string, v double")
    dots, numbers = tiles.pair_products(rows, "k", "f", "v", keys, along)
    got = {(r["a"], r["b"]): r["dot"] for r in dots.collect()}
    assert got.keys() == {(a, b) for a in range(11) for b in range(a + 1, 11)} and all(abs(d - x[a] @ x[b]) < 1e-12 for (a, b), d in got.items())
    assert [r["k"] for r in numbers.orderBy("_key").collect()] == [f"k{i:02}" for i in range(11)]
    plan = A.sample_distances(rows, "k", "f", "v")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert tiles.pair_products(rows.limit(0), "k", "f", "v", keys, along)[0].count() == 0


@pytest.mark.parametrize(("keys", "along"), [(None, 256), (4, 3), (2, 256), (1, 1)])
def test_distances_leave_the_tiles_as_whole_rows(spark, keys, along):
    rng = np.random.default_rng(6)
    x = np.where(rng.random((150, 7)) < 0.5, rng.integers(1, 9, (150, 7)), 0).astype(float)
    x[:, 0] += 1
    rows = spark.createDataFrame([(f"k{i:03}", f"f{j}", float(x[i, j])) for i in range(150) for j in range(7) if x[i, j]] + [("none", "f0", None)], "k string, f string, v double")
    found = tiles.pair_distances(rows, "k", "f", "v", 6, keys, along)
    got = {(r["a"], r["b"]): r["distance"] for r in found.collect()}
    assert got == {(f"k{i:03}", f"k{j:03}"): round(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), 6) for i in range(150) for j in range(i + 1, 150)}
    after = found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]  # what the rows of the result go through
    assert not any(step in after for step in ("Join", "Repartition", "Aggregate", "Sort", "round("))
    assert tiles.pair_distances(rows.limit(0), "k", "f", "v", 6, keys, along).count() == 0
    assert tiles.pair_distances(rows.filter("k = 'k001'"), "k", "f", "v", 6, keys, along).count() == 0


@pytest.mark.parametrize(("n", "m"), [(1, 0), (2, 0), (150, 0), (1, 1), (33, 131), (40, 4200)])
def test_pieces_of_a_tile_are_small_and_come_by_many(n, m):
    rng = np.random.default_rng(7)
    x = [rng.integers(1, 9, (k, 3)).astype(float) for k in (n, m) if k]
    sides = []
    for s, values in enumerate(x):
        side = tiles._Side(len(values))
        for j in range(3):
            order = rng.permutation(len(values))
            side.add(order, np.full(len(values), j), values[order, j], pa.array([f"{s}-{i:04}" for i in order]))
        sides.append(side)
    batches = list(tiles._pieces(sides[0], sides[1] if m else None, lambda a, b: -2 * x[0][a] @ x[-1][b].T, 6))
    pieces = [p for b in batches for p in b.to_pylist()]
    got = [(a, b, p["distance"][i * len(p["second"]) + j]) for p in pieces for i, a in enumerate(p["first"]) for j, b in enumerate(p["second"])]
    far = lambda i, j: round(float(np.sqrt(((x[0][i] - x[-1][j]) ** 2).sum())), 6)
    wanted = [(f"0-{i:04}", f"{len(x) - 1}-{j:04}", far(i, j)) for i in range(n) for j in (range(m) if m else range(i + 1, n))]
    assert sorted(got) == wanted
    assert all(len(p["distance"]) == len(p["first"]) * len(p["second"]) <= 1024 for p in pieces)  # Spark holds the rows of a piece
    assert len(batches) <= 3 * (n / tiles.ROWS + 1) and (m < 4200 or max(len(b) for b in batches) >= 64)


def test_rounding_near_halves_and_of_large_numbers():
    below, wide = np.nextafter(0.5, 0), np.array([2.0**51 + 0.5, 2.0**52 - 0.5, 2.0**52 + 1])
    assert tiles.rounded(np.array([below, np.nextafter(2.5, 0), 2.5, 3.5]), 0).tolist() == [0, 2, 3, 4]
    assert tiles.rounded(wide, 0).tolist() == [2.0**51 + 1, 2.0**52, 2.0**52 + 1]


def test_rounding_is_halves_up():
    got = tiles.rounded(np.array([0.5, 1.5, 2.4999, 1e300, np.inf, 0.0]), 0)
    assert got.tolist() == [1, 2, 2, 1e300, np.inf, 0] and np.isnan(tiles.rounded(np.array([np.nan]), 6)[0]) and tiles.rounded(np.array([2.0**0.5]), 6)[0] == 1.414214


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": rng.normal(size=3000), "one": np.array([5.0]), "ties": np.array([1.0, 1.0, 1.0, 2.0]), None: rng.normal(size=10)}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None)], "g string, v double")
    shares = {"low": 0.01, "middle": 0.5, "high": 0.99, "all": 1.0}
    got = {r["g"]: r for r in exact_quantiles(rows, ["g"], "v", shares).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert all(abs(got[g][name] - np.quantile(vs, q)) < 1e-12 for name, q in shares.items())
    assert exact_quantiles(rows.limit(0), ["g"], "v", shares).count() == 0


@pytest.mark.parametrize(("n", "width", "k"), [(200, 64, 5), (90, 1500, 4), (5, 30, 9)])
def test_wide_pca_is_the_exact_one(spark, n, width, k):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((n, width)) < 0.3, rng.normal(size=(n, width)) + 1, 0) + 100 * (np.arange(width) == 3)
    rows = spark.createDataFrame([(i, [int(j) for j in np.flatnonzero(r)] + [0], [float(v) for v in r[r != 0]] + [None]) for i, r in enumerate(x)], "id long, at array<int>, x array<double>")
    scores, loadings, ratio = A.sparse_pca(rows, "id", width, k)
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    k = min(k, n)
    wanted = v[:k].T * s[:k] / np.sqrt(n - 1)
    assert np.allclose(ratio, (s**2 / (s**2).sum())[:k], atol=1e-9)
    assert np.allclose(np.abs(loadings), np.abs(wanted), atol=1e-6)
    got = np.array([r["scores"] for r in scores.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :k] * s[:k]), atol=1e-6)


def test_pca_of_many_columns(spark):
    # Three directions over 20,000 columns, most cells empty.
    n, width = 150, 20_000
    rows = spark.range(n).select("id", F.expr(f"sequence(cast(id % 50 as int), {width - 1}, 50)").alias("at"))
    rows = rows.withColumn("x", F.transform("at", lambda j: F.when(F.col("id") % 3 == 0, 5.0).otherwise(1.0) + (F.hash(F.col("id"), j) % 100) / 1000))
    scores, loadings, ratio = A.sparse_pca(rows, "id", width, 3)
    data = np.zeros((n, width))
    for r in rows.collect():
        data[r["id"], r["at"]] = r["x"]
    s = np.linalg.svd(data - data.mean(0), compute_uv=False)
    assert loadings.shape == (width, 3) and np.allclose(ratio, (s**2 / (s**2).sum())[:3], atol=1e-8) and scores.count() == n


def test_curves_of_many_standards(spark, monkeypatch):
    rng = np.random.default_rng(21)
    rows = []
    for p in range(6):
        for k in range(300 if p < 4 else 5):
            conc = float(np.exp(rng.uniform(-6, 9)))
            bent = 0.0 if abs(np.log(conc)) < 3 + p else rng.normal(0, 2)
            rows.append((f"p{p}", f"f{k}", conc * float(np.exp(rng.normal(0, 0.05) + bent)), conc))
    rows += [("p0", "x", 0.0, 1.0), ("none", "f", 0.0, 0.0), ("two", "f", 1.0, 2.0), ("two", "g", 2.0, 4.0), ("p1", "same", 3.0, 3.0), ("p1", "same", 3.0, 3.0)]
    training = spark.createDataFrame(rows, "peak_label string, ms_file string, value double, std_conc double")
    for mode in (J.FIXED, J.FREE, J.BOUNDED):
        found = {}
        for many in (J.MANY, 10, 2):
            monkeypatch.setattr(J, "MANY", many)
            found[many] = {r["peak_label"]: r for r in J.calibration_curves(training, mode).collect()}
        arrays = found.pop(max(found))
        assert len(arrays) == 8 and any(r["n_points"] < 200 for r in arrays.values())
        for other in found.values():
            assert other.keys() == arrays.keys()
            for p, r in arrays.items():
                assert other[p]["n_points"] == r["n_points"] and all(other[p][c] == r[c] or abs(other[p][c] - r[c]) < 1e-8 for c in ("slope", "intercept", "residual", "lloq", "uloq", "lin_range_min", "lin_range_max")), (mode, p)
        monkeypatch.undo()


def test_metadata_rows_in_the_order_of_the_files(spark, tmp_path):
    # The later file is larger, so Spark reads it first; splits of a few bytes.
    (tmp_path / "a.csv").write_text("ms_file_label,label\n" + "".join(f"f{k % 5},{k}\n" for k in range(40)))
    (tmp_path / "b.csv").write_text("ms_file_label,label\n" + "".join(f"f{k % 9},later{k}\n" for k in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        read = readers.in_source_order(spark.read.option("header", True).schema("ms_file_label string, label string").csv(str(tmp_path)))
        got = {r["ms_file_label"]: r["label"] for r in N.read_metadata([read]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {f"f{k}": str(k) if k < 5 else f"later{k}" for k in range(9)}


def test_deep_pages(spark):
    rows = spark.range(5000).select("id", (F.hash("id") % 7).alias("a"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("Xy"), F.hash("id") % 3)).alias("b"))
    for sorts in ([("a", "descend"), ("b", "ascend")], [("b", "descend")], [("id", "ascend")]):
        every = rows.orderBy(*R.sort_keys(rows, sorts, "id")).collect()
        for offset, limit in ((0, 10), (137, 20), (4490, 30), (4990, 30), (4999, 1), (5000, 10), (9000, 10), (1200, 700)):
            for shallow in (50, 1):
                got = R.page(rows, sorts, "id", offset, limit, shallow).collect()
                assert [r["id"] for r in got] == [r["id"] for r in every[offset : offset + limit]] and {r["total"] for r in got} <= {5000}
            if limit != 30:
                break
    assert R.page(rows.limit(0), [("id", "ascend")], "id", 100, 10, 5).count() == 0
    assert R.page(rows, [("absent", "ascend")], "absent", 100, 10, 5).count() == 10


def test_thinning_keeps_nulls_and_short_traces(spark):
    rows = spark.createDataFrame([("a", [float(k) for k in range(30)], [float(k % 7) for k in range(30)]), ("b", None, None), ("c", [1.0, 2.0], [3.0, None]), ("d", [], []), ("e", [float(k) for k in range(40)], [None if k % 2 else float(k) for k in range(40)])], "k string, scan_time array<double>, intensity array<double>")
    got = {r["k"]: r for r in X.lttb(rows, 6).collect()}
    keep = X.lttb_points(np.arange(30.0), np.arange(30.0) % 7, 6)
    assert got["a"]["scan_time"] == keep.tolist() and got["a"]["intensity"] == (keep % 7).tolist()
    assert got["b"]["scan_time"] is None and got["c"]["intensity"] == [3.0, None] and got["d"]["scan_time"] == [] and len(got["e"]["scan_time"]) == 6
    assert X.lttb(rows, 2).count() == 5 and X.lttb(rows.limit(0), 6).count() == 0


def test_saved_table(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{k % 40}", f"p{k % 7}", k, None if k % 3 else [float(k)]) for k in range(400)], "ms_file_label string, peak_label string, n int, v array<double>")
    table = SavedTable(spark, f"file://{tmp_path}/t").create(rows, "ms_file_label", 16)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(table.read()) == key(rows)
    before, files = table.read(), set(table.read().inputFiles())
    # A row of one file: one part is written anew, the others keep their files, and old readers keep what they had.
    new = spark.createDataFrame([("f3", "p3", -1, None), ("f3", "new", -2, [1.0])], rows.schema)
    touched = table.upsert(new, ["ms_file_label", "peak_label"])
    assert len(touched) == 1
    wanted = new.unionByName(rows.join(new.select("ms_file_label", "peak_label"), ["ms_file_label", "peak_label"], "left_anti").select(rows.columns))
    assert key(table.read()) == key(wanted)
    now = set(table.read().inputFiles())
    assert all(f"_part={next(iter(touched))}/" in f for f in now ^ files) and len(now & files) > 10
    assert key(before) == key(rows)

    def lost(x):
        raise RuntimeError("lost")

    state = table.version()
    with pytest.raises(Exception, match="lost"):
        table.change(lambda old: old.withColumn("n", F.udf(lost, "int")("n")), lambda s: set(range(16)))
    assert table.version() == state and key(table.read()) == key(wanted)
    # By a key that parts don't go by, by one that isn't there, and all rows of a part.
    assert table.delete(spark.createDataFrame([("new", 1)], "peak_label string, x int"), ["peak_label"]) == touched
    assert table.delete(spark.createDataFrame([("new",)], "other string"), ["other"]) == set() == table.delete(spark.createDataFrame([("nobody",)], "peak_label string"), ["peak_label"])
    assert table.read().filter("peak_label = 'new'").count() == 0
    table.update(spark.createDataFrame([("f5", 77), ("f6", None)], "ms_file_label string, n int"), "ms_file_label", ["n"])
    assert {r["n"] for r in table.read().filter("ms_file_label = 'f5'").collect()} == {77} and table.read().filter("ms_file_label = 'f6' AND n IS NULL").count() == 0
    table.delete(rows, ["ms_file_label"])
    assert table.read().count() == 0 and table.read().schema == before.schema
    table.upsert(new, ["ms_file_label"])
    assert key(table.read()) == key(new)
    empty = SavedTable(spark, f"file://{tmp_path}/e").create(rows.limit(0), "ms_file_label", 4)
    assert empty.read().count() == 0 and empty.delete(rows, ["ms_file_label"]) == set()
