"""mzML and mzXML files as point rows (A2).

Files of at most ``WHOLE_BYTES`` come through ``binaryFile``, from any store that Spark reads, many
files a task; a file's points are handed on once all of it is read. Larger ones, also those over the 2 GB
that a row can hold, are cut into byte ranges. A task looks for the starts of scans in its range, reads those
that begin inside up to their ends, and writes them down with a row that says how the range ended. A file
counts as read only if all its ranges ended well and fit together: no point comes from a file that breaks
off. Either way a file that isn't valid XML gives no point, and its name with the error from ``ingest_errors``.
(A comment that holds the start of a scan makes a large file an error.)
"""

from __future__ import annotations

import base64
import io
import math
import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import IO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.sources.readers import POINTS2
from ionlake.sources.staging import staged

SPECTRA = POINTS2 + ", ms_level int, polarity string, acquisition_datetime string, error string"
ROWS = 100_000
#: mzML files up to this size are parsed as a whole tree, others element by element.
TREE_BYTES = 1 << 20
#: Files up to this size are read in one piece; larger ones in ranges of SPLIT_BYTES.
WHOLE_BYTES = 32 << 20
SPLIT_BYTES = 64 << 20
_SECONDS = re.compile(r"^P(?:T(?:([\d.]+)H)?(?:([\d.]+)M)?(?:([\d.]+)S)?)$", re.I)
_SCAN = re.compile(r"scan=(\d+)")
# Controlled-vocabulary accessions.
LEVEL, POSITIVE, NEGATIVE, START = "MS:1000511", "MS:1000130", "MS:1000129", "MS:1000016"
OF_SCANS = {LEVEL, POSITIVE, NEGATIVE, START, "MS:1000512", "MS:1000744"}
FLOAT32, ZLIB, MZ, INTENSITY, FILTER, ION = "MS:1000521", "MS:1000574", "MS:1000514", "MS:1000515", "MS:1000512", "MS:1000744"


@lru_cache(1024)
def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def seconds(text: str | None) -> float:
    text = (text or "").strip()
    try:
        return float(text)
    except ValueError:
        found = _SECONDS.match(text)
        return sum(float(x or 0) * k for x, k in zip(found.groups(), (3600, 60, 1), strict=True)) if found else 0.0


def decode(text: str | None, bits: int, packed: bool, order: str) -> np.ndarray:
    raw = base64.b64decode(text or "")
    raw = zlib.decompress(raw) if packed and raw else raw
    return np.frombuffer(raw, f"{order}f{bits // 8}").astype(np.float64)


def _mzml_scan(e: ET.Element) -> dict:
    found = _SCAN.search(e.get("id", ""))
    scan = {"id": int(found[1]) if found else int(e.get("index") or 0) + 1, "time": 0.0, "level": 1, "polarity": None, "precursor": None, "filter": None, "mz": np.zeros(0), "intensity": np.zeros(0)}
    for part in e.iter():
        name = _name(part.tag)
        if name == "cvParam":
            kind = part.get("accession")
            if kind not in OF_SCANS:
                continue
            value = part.get("value") or ""
            if kind == LEVEL:
                scan["level"] = int(value or 1)
            elif kind in (POSITIVE, NEGATIVE):
                scan["polarity"] = "Positive" if kind == POSITIVE else "Negative"
            elif kind == START:
                scan["time"] = float(value or 0) * (60.0 if part.get("unitName") == "minute" else 1.0)
            elif kind == FILTER:
                scan["filter"] = value
            elif kind == ION and scan["precursor"] is None:
                scan["precursor"] = float(value or "nan")
        elif name == "binaryDataArray":
            kinds = {x.get("accession") for x in part if _name(x.tag) == "cvParam"}
            text = next((x.text for x in part if _name(x.tag) == "binary"), "")
            if kinds & {MZ, INTENSITY}:
                scan["mz" if MZ in kinds else "intensity"] = decode(text, 32 if FLOAT32 in kinds else 64, ZLIB in kinds, "<")
    return scan


def _mzxml_scan(e: ET.Element) -> dict:
    own = {_name(x.tag): x for x in e}
    peaks, ion = own.get("peaks"), own.get("precursorMz")
    both = decode(peaks.text, int(peaks.get("precision") or 32), peaks.get("compressionType") == "zlib", ">") if peaks is not None else np.zeros(0)
    return {
        "id": int(e.get("num") or 0), "time": seconds(e.get("retentionTime")), "level": int(e.get("msLevel") or 1), "polarity": "Positive" if e.get("polarity") == "+" else "Negative",
        "precursor": float(ion.text) if ion is not None and ion.text else None, "filter": e.get("filterLine"), "mz": both[0::2], "intensity": both[1::2],
    }


def scans(events: Iterable[tuple[str, ET.Element | None]], state: dict | None = None) -> Iterator[dict]:
    """Scans with points, in document order: a scan that holds others comes before them.

    ``events`` are starts and ends of elements; a "border" among them says that scans that start later
    are someone else's. ``state`` gets the number of open scans there, and the least so far.
    """
    when, kind, mine = None, None, True
    above: list[ET.Element] = []
    open_: list[list] = []  # element of each scan that we are in, and whether it is done
    state = {} if state is None else state
    for event, e in events:
        if event == "border":
            mine = False
            state["open"] = len(open_)
            for scan_of in open_:
                if not scan_of[1] and len((scan := kind(scan_of[0]))["mz"]):
                    scan_of[1] = True
                    yield scan | {"when": when}
        if not mine and all(done for _, done in open_):
            return
        if event == "border":
            continue
        name = _name(e.tag)
        ours = (name == "spectrum" and kind is _mzml_scan) or (name == "scan" and kind is _mzxml_scan)
        if event == "start":
            if kind is None and name in ("mzML", "indexedmzML", "mzXML", "msRun"):
                kind = _mzml_scan if "mzML" in name else _mzxml_scan
            if name == "run":
                when = e.get("startTimeStamp")
            if ours:
                if open_ and not open_[-1][1]:
                    scan = kind(open_[-1][0])
                    if len(scan["mz"]):
                        open_[-1][1] = True
                        yield scan | {"when": when}
                open_.append([e, not mine or e.get(OUTER) is not None])
                state["least"] = min(state.get("least", 0), len(open_)) if e.get(OUTER) is None else len(open_)
            above.append(e)
            continue
        above.pop()
        if ours:
            done = open_.pop()[1]
            if mine:
                state["least"] = min(state.get("least", 0), len(open_))
            scan = None if done else kind(e)
            e.clear()
            if above:
                above[-1].remove(e)
            if scan is not None and len(scan["mz"]):
                yield scan | {"when": when}


def tree_scans(content: bytes) -> Iterator[dict]:
    """``scans`` of a small file from its tree, where it is mzML: its scans lie side by side and need no events."""
    root = ET.fromstring(content)
    if _name(root.tag) not in ("mzML", "indexedmzML"):
        yield from scans(ET.iterparse(io.BytesIO(content), events=("start", "end")))
        return
    when = None
    for e in root.iter():
        name = _name(e.tag)
        if name == "run":
            when = e.get("startTimeStamp")
        elif name == "spectrum":
            scan = _mzml_scan(e)
            if len(scan["mz"]):
                yield scan | {"when": when}


BROKEN = (ET.ParseError, ValueError, zlib.error)
NAMES = [c.split()[0] for c in SPECTRA.split(", ")]
TYPES = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]


def label_of(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


def say(e: Exception) -> str:
    return f"Invalid XML: {e}"[:200]


def points_of(path: str, content: IO[bytes]) -> list[pa.RecordBatch]:
    """Batches of one file's points, or one row with an error; level and polarity are those of its first scan with points."""
    label, level, polarity = label_of(path), None, None
    held: list[tuple] = []
    out: list[pa.RecordBatch] = []

    def flush() -> None:
        n, scan, mz, intensity, time, precursor, line, elm, when = zip(*held, strict=True)
        n = np.array(n)
        each = pa.array(np.repeat(np.arange(len(n)), n))
        whole = lambda value, t: pa.repeat(pa.scalar(value, t), len(each))
        spread = lambda values, t: whole(None, t) if not any(v is not None for v in values) else pa.array(values, t).take(each)
        columns = [whole(label, TYPES[0]), spread(scan, TYPES[1]), np.concatenate(mz), np.concatenate(intensity), np.repeat(time, n), spread(precursor, TYPES[5]), spread(line, TYPES[6]), spread(elm, TYPES[7]), whole(level, TYPES[8]), whole(polarity, TYPES[9]), spread(when, TYPES[10]), whole(None, TYPES[11])]
        out.append(pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip(columns, TYPES, strict=True)], NAMES))
        held.clear()

    total = 0
    try:
        small = content.size() <= TREE_BYTES if isinstance(content, pa.NativeFile) else False
        for s in tree_scans(content.read()) if small else scans(ET.iterparse(content, events=("start", "end"))):
            if level is None:
                level, polarity = s["level"], s["polarity"] or "Negative"
            n = min(len(s["mz"]), len(s["intensity"]))
            two = level == 2
            elm = f"{polarity} {spelled(s)}" if two and s["precursor"] is not None else None
            held.append((n, s["id"], s["mz"][:n], s["intensity"][:n], s["time"], s["precursor"] if two else None, s["filter"] if two else None, elm, s["when"]))
            total += n
            if total >= ROWS:
                flush()
                total = 0
    except BROKEN as e:
        row = {"ms_file_label": label, "error": say(e)}
        return [pa.RecordBatch.from_arrays([pa.array([row.get(n)], t) for n, t in zip(NAMES, TYPES, strict=True)], NAMES)]
    if total:
        flush()
    return out


def spelled(scan: dict) -> str:
    return f"{scan['precursor']:.3f} [{scan['mz'][0]:.3f}]"


# ---------------------------------------------------------------- ranges of large files
#: Attribute of the scans that are opened in front of a range, for those that were open there; and how many.
OUTER, DEEPEST = "opened-before", 16
#: Bytes that are read at a time, and that are looked at twice as a tag may be cut there.
READ_BYTES, OVERLAP = 1 << 20, 64
RANGE = "file string, start long, number int, scan_id int, scan_time double, level int, polarity string, acquired string, precursor double, filter string, spelled string, mz array<double>, intensity array<double>, closes int, opens int, error string"
_ROOT = re.compile(rb"<(?:\w+:)?(indexedmzML|mzML|mzXML|msRun)[\s>]")
_CLOSE = re.compile(rb"</(?:\w+:)?scan\s*>")


class Bytes:
    """A file from some byte on: ``held`` begins at byte ``at`` of the file."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.held = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        new = self.file.read(READ_BYTES)
        self.held += new
        return bool(new)

    def find(self, pattern: re.Pattern, least: int = 0, end: float = math.inf) -> int:
        """Where in the file the pattern starts, in [least, end); -1 if nowhere."""
        look = max(0, least - self.at)
        while True:
            found = pattern.search(self.held, look)
            if found:
                return self.at + found.start() if self.at + found.start() < end else -1
            look = max(look, len(self.held) - OVERLAP)
            if self.at + look >= end or not self.more():
                return -1

    def skip(self, to: int) -> None:
        self.held, self.at = self.held[to - self.at :], to


def _marker(head: bytes) -> tuple[re.Pattern, bool]:
    """What a scan begins with, and whether scans hold scans."""
    if b"\0" in head:
        raise ValueError("only encodings that keep ASCII as it is can be read in ranges")
    root = _ROOT.search(head)
    nested = root is not None and root[1] in (b"mzXML", b"msRun")
    return re.compile(rb"<(?:\w+:)?(?:%s)[\s/>]" % (b"scan" if nested else b"spectrum")), nested


def range_of(path: str, file: pa.NativeFile, start: int, end: int) -> Iterator[dict]:
    """The scans that begin in [start, end), then a row that says how the range ended (columns of RANGE).

    The elements that hold all scans are read from the head of the file. Scans of mzXML may lie in
    others that began earlier, so some are opened in front of the range; how many of them it closes, and how many
    scans it leaves open, must fit the ranges before and after.
    """
    own = {"file": path, "start": start}
    try:
        top = Bytes(file, 0)
        top.more()
        pattern, nested = _marker(top.held)
        first = top.find(pattern)
        if first < 0:  # no scans: the first range looks at the file as a whole
            if start == 0:
                ET.fromstring(top.held)
                yield own | {"closes": 0, "opens": 0}
            return
        body = Bytes(file, start)
        begin = body.find(pattern, max(start, first), end)
        if begin < 0:
            return
        body.skip(begin)
        state, outer = {}, DEEPEST if nested else 0
        for number, s in enumerate(scans(_events(top.held[:first], outer, body, end, pattern, nested), state)):
            values = {"number": number, "scan_id": s["id"], "scan_time": s["time"], "level": s["level"], "polarity": s["polarity"], "acquired": s["when"], "precursor": s["precursor"], "filter": s["filter"]}
            n = min(len(s["mz"]), len(s["intensity"]))
            yield own | values | {"spelled": None if s["precursor"] is None else spelled(s), "mz": s["mz"][:n], "intensity": s["intensity"][:n]}
        yield own | {"closes": outer - state["least"], "opens": state["open"] - state["least"]}
    except BROKEN as e:
        yield own | {"error": say(e)}


def _events(head: bytes, outer: int, body: Bytes, end: int, pattern: re.Pattern, nested: bool) -> Iterator[tuple[str, ET.Element | None]]:
    """Events of the elements around a range, of its own, and of what comes after it for as long as anyone asks."""
    parser, border = ET.XMLPullParser(events=("start", "end")), False

    def feed(to: int) -> Iterator[tuple[str, ET.Element | None]]:
        parser.feed(body.held[:to])
        body.skip(body.at + to)
        return parser.read_events()

    parser.feed(head + f'<scan {OUTER}="1">'.encode() * outer)
    yield from parser.read_events()
    while True:
        stop = None if border else pattern.search(body.held, max(0, end - body.at))
        if stop:  # a scan of another range
            yield from feed(stop.start())
            yield "border", None
            border = True
        elif border:
            yield from feed(len(body.held))
        elif nested:  # what follows the last scan closes elements around those that were opened in front
            yield from feed(max((m.end() for m in _CLOSE.finditer(body.held)), default=0))
        else:
            yield from feed(max(0, len(body.held) - OVERLAP))
        if not body.more():
            break
    if nested and not border:
        ET.fromstring(head + body.held)
    else:
        yield from feed(len(body.held))
        parser.close()  # an error if the file ends inside a scan
    yield "border", None


def read_ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Scans and ends of ranges (RANGE) of files given by path and length; a file's ranges go to many tasks."""
    spark = files.sparkSession
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = files.select("path", starts.alias("start"), "length")
    kinds = pa.schema([("file", pa.string()), ("start", pa.int64()), ("number", pa.int32()), ("scan_id", pa.int32()), ("scan_time", pa.float64()), ("level", pa.int32()), ("polarity", pa.string()), ("acquired", pa.string()), ("precursor", pa.float64()), ("filter", pa.string()), ("spelled", pa.string()), ("mz", pa.list_(pa.float64())), ("intensity", pa.list_(pa.float64())), ("closes", pa.int32()), ("opens", pa.int32()), ("error", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
                store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                rows, total = [], 0
                with store.open_input_file(at) as file:
                    for row in range_of(path, file, start, start + split_bytes):
                        rows.append(row)
                        total += len(row.get("mz", ()))
                        if total >= ROWS:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, total = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(n, F.xxhash64("path", "start")).mapInArrow(read, RANGE)


def commits(ranges: DataFrame) -> DataFrame:
    """A row for each file: whether all its ranges ended well and fit together, and level, polarity and time of its first scan."""
    ends = F.array_sort(F.collect_list(F.when(F.col("scan_id").isNull(), F.struct("start", "closes", "opens", "error"))))
    first = F.min(F.when(F.col("scan_id").isNotNull(), F.struct("start", "number", "level", F.coalesce("polarity", F.lit("Negative")).alias("polarity"), "acquired")))
    found = ranges.groupBy("file").agg(ends.alias("_ends"), first.alias("_first"))
    # Open scans after each range; below zero for good once a range closes more than were open.
    left = F.aggregate("_ends", F.lit(0), lambda c, r: F.when(c < r["closes"], F.lit(-(1 << 20))).otherwise(c - r["closes"] + r["opens"]))
    said = F.filter(F.transform("_ends", lambda r: r["error"]), lambda e: e.isNotNull())
    error = F.when(F.size(said) > 0, F.element_at(said, 1)).when(F.coalesce(left, F.lit(-1)) != 0, F.lit("Invalid XML: scans are not closed"))
    return found.select("file", error.alias("error"), F.col("_first.level").alias("ms_level"), F.col("_first.polarity").alias("polarity"), F.col("_first.acquired").alias("acquisition_datetime"))


def _ingest_large(files: DataFrame, split_bytes: int) -> DataFrame:
    ranges = staged(read_ranges(files, split_bytes), "spectra")
    found = commits(ranges)
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "").alias("ms_file_label")
    names = {c.split()[0]: c.split()[1] for c in SPECTRA.split(", ")}
    bad = found.filter("error IS NOT NULL").select(*[stem if c == "ms_file_label" else F.col(c) if c == "error" else F.lit(None).cast(t).alias(c) for c, t in names.items()])
    two = F.col("ms_level") == 2
    scan_rows = ranges.filter("scan_id IS NOT NULL").drop("polarity", "error", "level", "acquired", "start", "number", "closes", "opens").join(found.filter("error IS NULL").drop("error"), "file")
    points = scan_rows.select("*", F.explode(F.arrays_zip("mz", "intensity")).alias("_p"))
    values = {
        "ms_file_label": stem, "mz": F.col("_p.mz"), "intensity": F.col("_p.intensity"), "mz_precursor": F.when(two, F.col("precursor")), "filterLine": F.when(two, F.col("filter")),
        "filterLine_ELMAVEN": F.when(two, F.concat("polarity", F.lit(" "), "spelled")), "error": F.lit(None).cast("string"),
    }
    return points.select(*[values[c].alias(c) if c in values else F.col(c) for c in names]).unionByName(bad)


def ingest_spectra(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A2: the points of every mzML and mzXML file under ``path`` (columns of SPECTRA)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{mzML,mzXML,mzml,mzxml}").option("recursiveFileLookup", True).load(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from points_of(file.as_py(), pa.BufferReader(content.as_buffer()))

    small = files.filter(F.col("length") <= whole_bytes).select("path", "content").mapInArrow(read, SPECTRA)
    large = files.filter(F.col("length") > whole_bytes).select("path", "length")  # the contents are not read here
    return small if large.isEmpty() else small.unionByName(_ingest_large(large, split_bytes))


def good_points(spectra: DataFrame) -> DataFrame:
    return spectra.filter("error IS NULL").drop("error")


def ingest_errors(spectra: DataFrame) -> DataFrame:
    return spectra.filter("error IS NOT NULL").select("ms_file_label", "error")
