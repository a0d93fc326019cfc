"""Removing lines that many documents repeat, through a sharded minimal perfect hash.

A line's key is the line without white space at both ends, ``A-Z`` lower-cased. Keys of at
least ``min_chars`` code points that at least ``min_docs`` documents hold are repeated: they
lose all their lines except in the document with the largest id that holds them.

1. Every document gives the 128-bit hashes of its distinct keys. They are counted with a
   partial sum in each batch and in each task, so a line of a third of all documents is a
   row a task by the time it is shuffled.
2. The repeated keys are dealt to shards by their hash, about ``SHARD_KEYS`` each. A shard
   becomes a minimal perfect hash (bit arrays in levels: a key that is alone at its place of
   a level takes it, the others go to the next one; the rank of a key's bit is its slot) and
   three arrays by slot: fingerprints of 64 bits, counts in the narrowest type, and the ids
   that keep the line.
3. Documents probe the arrays. A fingerprint that differs means a line that is not repeated.
   Shards are dealt to groups of at most ``GROUP_KEYS`` keys, about 100 MB, as many as a
   worker holds. With one group the workers read it from the shared folder and no row moves.
   With more, hashes (never texts) go to tasks by group and by document, so that neither a
   group nor a common line is one task's; their hits come back to the documents by id and text.

Edge cases: a null or empty text is one empty line, which is never repeated while ``min_chars``
is positive. Every row is a document of its own; of rows that share the largest id all keep the
line. A null id is smaller than any other; if only null ids hold a line all of them keep it.
A line that occurs several times in a document counts once, and all its occurrences stay or go.
Very long texts are one value of a batch and are never cut. An empty table gives an empty table;
extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.shared import Stage, mix, only

#: Keys of one minimal perfect hash.
SHARD_KEYS = 1 << 16
#: Keys of the shards that a worker holds at a time.
GROUP_KEYS = 1 << 22
#: Bits of a level for each key that gets there.
GAMMA = 1.5

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


# ---------------------------------------------------------------- keys
def key_of(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()  # of bytes, lower() changes A-Z alone


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def hash_lines(text: bytes, min_chars: int, known: dict[bytes, bytes]) -> list[tuple[int, bytes]]:
    """(number, 128-bit hash) of every line whose key is long enough; ``known`` saves lines hashed before."""
    out = []
    for number, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars and long_enough(key := key_of(line), min_chars):
            found = known.get(key)
            if found is None:
                found = known[key] = hashlib.blake2b(key, digest_size=16).digest()
            out.append((number, found))
    return out


def halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def texts_of(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


# ---------------------------------------------------------------- counting
def line_counts(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, docs, keeper) of every distinct key: its hash, how many documents hold it and their largest id."""
    source = only(docs, id_col, text_col)
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, hashes, known = [], [], {}
            for k, text in enumerate(texts_of(batch.column(1))):
                own = {h for _, h in hash_lines(text, min_chars, known)}
                row += [k] * len(own)
                hashes += own
            h1, h2 = halves(hashes)
            found = pa.table({"h1": h1.view(np.int64), "h2": h2.view(np.int64), "keeper": batch.column(0).take(pa.array(row, pa.int64()))})
            found = found.group_by(["h1", "h2"]).aggregate([([], "count_all"), ("keeper", "max")])
            yield from found.select(["h1", "h2", "count_all", "keeper_max"]).rename_columns(["h1", "h2", "docs", "keeper"]).combine_chunks().to_batches()

    counted = source.mapInArrow(run, f"h1 long, h2 long, docs long, keeper {kind}")
    return counted.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))


# ---------------------------------------------------------------- the index
def places(h1: np.ndarray, h2: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    """Where the keys fall on a level of ``size`` bits."""
    with np.errstate(over="ignore"):
        return (mix(h1 + h2 * np.uint64(2 * level + 1)) % np.asarray(size, np.uint64)).astype(np.int64)


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(words of each level, bits of all levels, slot of each key) for distinct pairs of hashes."""
    sizes, levels, left, bit_of = [], [], np.arange(len(h1)), np.zeros(len(h1), np.int64)
    before = 0
    while len(left):
        n_words = -(-int(GAMMA * len(left) + 1) // 64)
        at = places(h1[left], h2[left], len(sizes), 64 * n_words)
        alone = np.bincount(at, minlength=64 * n_words) == 1
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(n_words)
        own = alone[at]
        bit_of[left[own]] = before + at[own]
        before += 64 * n_words
        left = left[~own]
    bits = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
    return sizes, bits, ranks_of(bits, starts_of(bits), bit_of)


def starts_of(bits: np.ndarray) -> np.ndarray:
    """Set bits before each word."""
    counts = np.bitwise_count(bits).astype(np.int64)
    return np.cumsum(counts) - counts


def ranks_of(bits: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return starts[at >> 6] + np.bitwise_count(bits[at >> 6] & below).astype(np.int64)


def narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def build_index(repeated: DataFrame, stage: Stage, keys: int, group_keys: int = GROUP_KEYS, shard_keys: int = SHARD_KEYS) -> tuple[str, int, int]:
    """Writes a row for each shard, by group; (folder, shards, groups). ``keys`` is the number of rows of ``repeated``."""
    groups = max(1, -(-keys // group_keys))
    shards = groups * max(1, -(-min(keys, group_keys) // shard_keys))
    kind = repeated.schema["keeper"].dataType.simpleString()
    of_shard = F.pmod(F.col("h1"), F.lit(shards)).cast("int")

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        sizes, bits, slot = perfect_hash(h1, h2)
        order = np.argsort(slot)
        counts = narrow(table.column("docs").to_numpy()[order])
        row = {
            "shard": table.column("shard")[0].as_py(),
            "levels": sizes,
            "bits": bits.tobytes(),
            "prints": h2[order].tobytes(),
            "counts": counts.tobytes(),
            "count_bytes": counts.itemsize,
        }
        keepers = table.column("keeper").combine_chunks().take(pa.array(order))
        made = pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), (pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int32()), strict=True)})
        return made.append_column("keepers", pa.ListArray.from_arrays(pa.array([0, len(keepers)], pa.int32()), keepers))

    schema = f"shard int, levels array<int>, bits binary, prints binary, counts binary, count_bytes int, keepers array<{kind}>"
    made = repeated.withColumn("shard", of_shard).groupBy("shard").applyInArrow(build, schema)
    path = stage.path("index")
    made.withColumn("group", F.pmod(F.col("shard"), F.lit(groups))).write.partitionBy("group").parquet(path)
    stage.live["index"] = None
    return path, shards, groups


class Index:
    """The shards of one group, or of all, laid end to end."""

    def __init__(self, path: str, shards: int):
        files, at = fs.FileSystem.from_uri(path)
        found = pq.read_table(at, filesystem=files, partitioning=None).to_pylist() if _has_files(files, at) else []
        deepest = max([len(s["levels"]) for s in found], default=0)
        #: By shard and level: words, and the first one's number.
        self.words, self.first = np.zeros((shards, deepest), np.int64), np.zeros((shards, deepest), np.int64)
        before = 0
        for s in found:
            n = len(s["levels"])
            self.words[s["shard"], :n] = s["levels"]
            self.first[s["shard"], :n] = before + np.cumsum(s["levels"]) - s["levels"]
            before += sum(s["levels"])
        self.bits = np.frombuffer(b"".join(s["bits"] for s in found), np.uint64)
        self.starts = starts_of(self.bits)
        self.prints = np.frombuffer(b"".join(s["prints"] for s in found), np.uint64)
        widest = f"u{max([s['count_bytes'] for s in found], default=1)}"
        self.counts = np.concatenate([np.zeros(0, widest), *(np.frombuffer(s["counts"], f"u{s['count_bytes']}").astype(widest) for s in found)])
        self.keepers = pa.concat_arrays([pa.array(s["keepers"]) for s in found if s["keepers"] is not None]) if found else pa.array([])
        self.shards = shards

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for a key that is not in the index."""
        shard = (h1.view(np.int64) % self.shards).astype(np.int64)  # as pmod does
        slot, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level in range(self.words.shape[1]):
            left = left[self.words[shard[left], level] > 0]
            if not len(left):
                break
            s = shard[left]
            at = 64 * self.first[s, level] + places(h1[left], h2[left], level, 64 * self.words[s, level])
            here = (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            slot[left[here]] = ranks_of(self.bits, self.starts, at[here])
            left = left[~here]
        known = slot >= 0
        slot[known] = np.where(self.prints[slot[known]] == h2[known], slot[known], -1)
        return slot

    def lose(self, h1: np.ndarray, h2: np.ndarray, ids: pa.Array, min_docs: int) -> np.ndarray:
        """Whether a document with the id loses the line: it is repeated, and another document keeps it."""
        slot, out = self.slots(h1, h2), np.zeros(len(h1), bool)
        known = np.flatnonzero(slot >= 0)
        if len(known):
            keeper, own = self.keepers.take(pa.array(slot[known])), ids.take(pa.array(known)).cast(self.keepers.type)
            stays = pc.fill_null(pc.equal(keeper, own), False).to_numpy(zero_copy_only=False) | keeper.is_null().to_numpy(zero_copy_only=False)
            out[known] = ~stays & (self.counts[slot[known]] >= min_docs)
        return out


def _has_files(files: fs.FileSystem, at: str) -> bool:
    return files.get_file_info(at).type == fs.FileType.Directory


_loaded: dict[str, Index] = {}


def index_at(path: str, shards: int) -> Index:
    """The index of a folder; a worker holds one at a time."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Index(path, shards)
    return _loaded[path]


# ---------------------------------------------------------------- documents
def kept_lines(text: bytes, gone: list[int]) -> str:
    lines = text.split(b"\n")
    for number in gone:
        lines[number] = None
    return b"\n".join(line for line in lines if line is not None).decode()


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", group_keys: int = GROUP_KEYS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The id, n_lines (before), n_dropped and kept_text of every document."""
    stage = Stage(docs.sparkSession, "lines")
    counts = line_counts(docs, min_chars, id_col, text_col)
    repeated = stage.keep(counts.filter(F.col("docs") >= min_docs), "repeated")
    path, shards, groups = build_index(repeated, stage, repeated.count(), group_keys, shard_keys)
    stage.drop("repeated")
    source = only(docs, id_col, text_col)
    kind = source.schema[0].dataType.simpleString()
    schema = f"id {kind}, n_lines long, n_dropped long, kept_text string"
    if groups == 1:
        found = source.mapInArrow(_probing(f"{path}/group=0", shards, min_chars, min_docs), schema)
    else:
        found = _dealt(source.toDF("id", "text"), path, shards, groups, min_chars, min_docs, schema)
    return found.withColumnRenamed("id", id_col)


def _answer(ids: pa.Array, texts: list[bytes], gone: list[list[int]]) -> pa.RecordBatch:
    columns = [
        ids,
        pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()),
        pa.array([len(g) for g in gone], pa.int64()),
        pa.array([kept_lines(t, g) if g else t.decode() for t, g in zip(texts, gone, strict=True)], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["id", "n_lines", "n_dropped", "kept_text"])


def _probing(path: str, shards: int, min_chars: int, min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_at(path, shards)
        for batch in batches:
            texts, known = list(texts_of(batch.column(1))), {}
            lines = [hash_lines(t, min_chars, known) for t in texts]
            row = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
            number = np.array([n for x in lines for n, _ in x], np.int64)
            h1, h2 = halves([h for x in lines for _, h in x])
            lost = index.lose(h1, h2, batch.column(0).take(pa.array(row)), min_docs)
            gone: list[list[int]] = [[] for _ in texts]
            for k, n in zip(row[lost].tolist(), number[lost].tolist(), strict=True):
                gone[k].append(n)
            yield _answer(batch.column(0), texts, gone)

    return run


def _dealt(source: DataFrame, path: str, shards: int, groups: int, min_chars: int, min_docs: int, schema: str) -> DataFrame:
    """As with one group, for an index that no worker can hold: hashes go to tasks that hold their group."""
    kind = source.schema["id"].dataType.simpleString()
    print_type = pa.binary(16)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = list(texts_of(batch.column(1))), {}
            lines = [hash_lines(t, min_chars, known) for t in texts]
            row = pa.array(np.repeat(np.arange(len(texts)), [len(x) for x in lines]))
            h1, h2 = halves([h for x in lines for _, h in x])
            group = (h1.view(np.int64) % shards % groups).astype(np.int32)
            prints = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], print_type).cast(pa.binary())
            number = pa.array([n for x in lines for n, _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(group), batch.column(0).take(row), prints.take(row), number, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["group", "id", "print", "number", "h1", "h2"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, lost = batch.column("group").to_numpy(), np.zeros(len(batch), bool)
            h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                lost[at] = index_at(f"{path}/group={g}", shards).lose(h1[at], h2[at], batch.column("id").take(pa.array(at)), min_docs)
            yield batch.select(["id", "print", "number"]).filter(pa.array(lost))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _answer(batch.column(0), list(texts_of(batch.column(1))), [g or [] for g in batch.column(2).to_pylist()])

    n = max(groups, int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    flat = source.mapInArrow(hashes, f"group int, id {kind}, print binary, number long, h1 long, h2 long").distinct()
    dealt = flat.repartitionByRange(n, "group", "print", "number").sortWithinPartitions("group")
    lost = dealt.mapInArrow(probe, f"id {kind}, print binary, number long").groupBy(F.col("id").alias("_id"), F.col("print").alias("_print")).agg(F.collect_set("number").alias("gone"))
    printed = source.mapInArrow(_with_print, f"id {kind}, text string, print binary")
    joined = printed.join(lost, F.col("id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")), "left")
    return joined.select("id", "text", "gone").mapInArrow(answer, schema)


def _with_print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts_of(batch.column(1))], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, prints], ["id", "text", "print"])
