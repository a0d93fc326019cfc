"""Best-fit packing of tokenised documents into sequences of a fixed length.

Every document becomes its token ids and an end id. Documents over the sequence
length are cut into full pieces, the remainder first; a full piece is a sequence
of its own. All other pieces are dealt at random, by a hash, into groups that one
task packs by bounded-space online best-fit: at most ``open_bins`` bins are open;
a bitset over free space finds the open bin with the least room that still holds
the piece; where none does, a new bin opens, and if that is one too many, the
fullest bin closes first. A group's state is ``open_bins`` numbers however many
pieces it has, and a group leaves at most that many sequences part full, so the
number of groups follows the number of pieces (``pieces_per_group``).

Tokenising is the costly part and happens once: pieces without their ids are
written to the shared folder, then packed.

Edge cases: null text is the empty text, which is one piece of one end id;
repeated rows are packed as often as they occur; an empty table gives no
sequences; other columns of the input are not looked at. Very long texts are one value of a batch
and give as many pieces as they need. Of open bins with equal room the one that was filled last takes a piece.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.shared import Stage, only

#: Pieces whose packing one task does; the bound on a task, not on the table.
PIECES_PER_GROUP = 200_000
OPEN_BINS = 512

_encoders: dict[str, object] = {}


def encoder(path: str):
    """text -> uint32 ids of the byte-level BPE in a ``tokenizers`` JSON file.

    The file's vocabulary and merge order are handed to ``tiktoken``, whose merge
    loop is several times faster on one core and gives the same ids. The file's added
    tokens get their own ids wherever they stand in a text, as in ``Tokenizer.encode``;
    the text between them is encoded apart. Files whose added tokens take in spaces or
    stand for whole words only go to ``tokenizers`` itself.
    """
    if path not in _encoders:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, added = content["model"], {t["content"]: t for t in content.get("added_tokens") or []}
        # The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte = {chr(c): b for c, b in zip([*plain, *range(256, 256 + len(others))], [*plain, *others], strict=True)}
        ranks = {bytes(byte[c] for c in token): rank for token, rank in model["vocab"].items() if all(c in byte for c in token)}
        ranks = {k: v for k, v in ranks.items() if k != b"<|endoftext|>"}
        # Fixed value: the pre-tokenisation pattern of byte-level BPE.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        core = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def plain_text(text: str) -> np.ndarray:
            return core.encode_to_numpy(text, disallowed_special=())

        own = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

        def encode(text: str) -> np.ndarray:
            if own is None or not own.search(text):
                return plain_text(text)
            parts, at = [], 0
            for m in own.finditer(text):
                parts += [plain_text(text[at : m.start()]), np.array([added[m.group()]["id"]], np.uint32)]
                at = m.end()
            return np.concatenate([*parts, plain_text(text[at:])])

        if any(t.get(flag) for t in added.values() for flag in ("lstrip", "rstrip", "single_word")):
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            encode = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        _encoders[path] = encode
    return _encoders[path]


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids: the remainder first, then full ones."""
    if n <= length:
        return [(0, n)]
    first = n % length
    return ([(0, first)] if first else []) + [(start, length) for start in range(first, n, length)]


def pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and the ids themselves if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) if text else np.zeros(0, np.uint32)
                ids = np.append(ids.astype("<u4"), np.uint32(end_id)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), length)):
                    part = ids[start : start + n]
                    rows.append((doc, k, start, n, zlib.crc32(part.tobytes()), *([part] if with_ids else [])))
            columns = list(zip(*rows, strict=True)) or [[]] * (6 if with_ids else 5)
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "piece", "start", "length", "ids_crc32", "ids"][: len(types)])

    source = only(docs, id_col, text_col)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


class Bins:
    """Bounded-space best-fit: ``put`` says which sequence a piece goes to, and where."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.most = length, open_bins
        self.free = 0  # bit f is set if an open bin has f ids free
        self.by_free: dict[int, list[int]] = {}
        self.n_open = self.n = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.free ^= 1 << free
        self.n_open -= 1
        return found

    def put(self, n: int) -> tuple[int, int]:
        fits = self.free >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            which = self._take(free)
        else:
            if self.n_open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            free, which = self.length, self.n
            self.n += 1
        if free > n:  # a full bin is closed
            self.by_free.setdefault(free - n, []).append(which)
            self.free |= 1 << (free - n)
            self.n_open += 1
        return which, self.length - free


def pack(parts: DataFrame, length: int, open_bins: int = OPEN_BINS, pieces_per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Rows of ``parts`` (with id, piece and length) with sequence_id and offset.

    ``parts`` should be a written table, as its rows are counted first.
    """
    spark = parts.sparkSession
    groups = max(1, -(-parts.count() // pieces_per_group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = Bins(length, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = [bins.put(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + s for s, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())], [*batch.schema.names, "sequence_id", "offset"]
            )

    dealt = parts.repartition(groups, F.xxhash64("id", "piece")).sortWithinPartitions(F.xxhash64("ids_crc32", "id", "piece"), "id", "piece")
    schema = parts.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    parts = Stage(docs.sparkSession, "packing").keep(pieces(docs, tokenizer, length, end_id, id_col, text_col), "pieces")
    return pack(parts, length, open_bins).withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed training rows: sequence_id, ids, and the lengths of the pieces inside, in order."""
    parts = Stage(docs.sparkSession, "packing").keep(pieces(docs, tokenizer, length, end_id, id_col, text_col, with_ids=True), "pieces")
    rows = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    packed = pack(parts, length, open_bins).groupBy("sequence_id").agg(rows.alias("rows"))
    return packed.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.length").alias("lengths"))
