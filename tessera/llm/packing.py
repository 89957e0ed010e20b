"""Packing token sequences into windows by best-fit decreasing.

A document longer than a window is first cut into full windows. The remainders are dealt into
buckets of many thousand pieces by a hash, and each bucket is packed by itself: longest first, each into the
open window with the least room that is enough, which a segment tree over remaining capacities finds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import text_slices, written
from tessera.llm.tokens import SMALL_CACHE_BYTES, encoder, forget

WINDOW = 4096
#: Remainders that a bucket should hold: few windows stay open, and a task needs little memory.
BUCKET_PIECES = 40_000


class OpenWindows:
    """Windows by remaining capacity; a segment tree of counts finds the tightest that has enough room."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.at.setdefault(room, []).append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest window with room for `need`."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.at[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of every piece; pieces must come longest first and fit a window."""
    windows, offsets, opened, free = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0, OpenWindows(window)
    for i, n in enumerate(lengths.tolist()):
        room, at = free.take(n) or (window, opened)
        opened += at == opened
        windows[i], offsets[i] = at, window - room
        if room > n:
            free.put(room - n, at)
    return windows, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, with_ids: bool = False, release: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids as little-endian unsigned 32-bit) of every piece.

    A document is the ids of its whole text (null: empty) and end_id, cut into full windows and a remainder. release:
    workers work on fewer texts at once and let the vocabulary and known pieces go after each partition, for jobs in
    which other stages follow.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def cut(batches: Iterable) -> Iterator:
        import pyarrow as pa

        of = encoder(tokenizer, SMALL_CACHE_BYTES if release else None)
        kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for first, texts in text_slices(batch, 1024 if release else 4096):
                rows = []
                for key, ids in zip(keys[first:], of.ids(texts)):
                    ids += end
                    for at in range(0, len(ids), 4 * window):
                        part = ids[at : at + 4 * window]
                        rows.append((key, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4) + (part,) * with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        if release:
            forget(tokenizer)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(found: DataFrame, window: int = WINDOW, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """found (of pieces()) with sequence_id and offset: every piece in one window, no window over its size.

    Full windows stand alone. Sequence ids are unique; they tell the bucket and the window in it. Ties
    are packed by doc_id, start and checksum, so reruns agree; rows equal in all of them may swap places.
    Null doc_ids are packed like others; no pieces give no windows.
    """
    table = written(found, "pieces")
    full = table.where(F.col("length") == window)
    rest = table.where(F.col("length") < window)
    buckets = rest.count() // bucket_pieces + 1
    nth = F.monotonically_increasing_id()  # of a written table; full windows only need distinct ids
    alone = full.withColumns({"sequence_id": -1 - nth, "offset": F.lit(0).cast("long")})
    names = [*found.columns, "sequence_id", "offset"]

    def bfd(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        at, offsets = best_fit_decreasing(pdf["length"].to_numpy(), window)
        return pdf.assign(sequence_id=(int(pdf["bucket_"].iloc[0]) << 32) + at, offset=offsets)[names] if len(pdf) else pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    # Equal rows are numbered, so that a row that a table repeats very often fills buckets, not one.
    same = Window.partitionBy("doc_id", "start", "ids_crc32").orderBy("length")
    rest = rest.withColumn("part_", F.floor(F.row_number().over(same) / bucket_pieces))
    dealt = rest.withColumn("bucket_", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "part_"), F.lit(buckets)).cast("int")).drop("part_")
    return alone.select(*names).unionByName(dealt.groupBy("bucket_").applyInPandas(bfd, schema))


def packed_windows(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id and ids (window little-endian unsigned 32-bit integers, padded) from pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = F.lit(np.full(window, pad_id, "<u4").tobytes())
    return packed.groupBy("sequence_id").agg(joined.alias("ids")).select("sequence_id", F.substring(F.concat("ids", pad), 1, 4 * window).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, release: bool = False) -> DataFrame:
    return pack(pieces(docs, tokenizer, end_id, window, release=release), window)
