"""Directly addressable codes for token ids: any id can be read without decoding a block.

An id is cut into chunks of 8 bits, lowest first. Level k holds chunk k of every id that has one, in
order, and a bitmap that tells which of them go on in level k + 1. The position there is the number of
set bits before, which a directory of counts for every 512 bits and the bits since give at once.

A segment is the bytes of: magic, numbers of documents and ids; documents' ids and lengths; for each level its
length, chunks, bitmap and rank directory. Segments are rows of a Parquet table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import text_slices, written
from tessera.llm.tokens import encoder

MAGIC = b"DAC1"
#: Bits that one entry of the rank directory spans.
BLOCK = 512
#: Ids after which a segment ends; a document is never cut.
SEGMENT = 1 << 18


class Codes:
    """Directly addressable codes of a sequence of unsigned 32-bit ids."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int):
        self.levels, self.n = levels, n

    @classmethod
    def of(cls, ids: np.ndarray) -> "Codes":
        levels, left, n = [], ids.astype("<u4"), len(ids)
        while True:
            more = left > 255
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
            ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1)
            levels.append(((left & 255).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(ones)]).astype("<u8")))
            if not more.any():
                return cls(levels, n)
            left = left[more] >> 8

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            since = bits[block * (BLOCK // 8) : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(since).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
        return value

    def all(self) -> np.ndarray:
        out, at, shift = np.zeros(self.n, "<u4"), None, 0
        for chunks, bits, _ in self.levels:
            part = chunks.astype("<u4") << np.uint32(shift)
            if at is None:
                out |= part
                at = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            else:
                out[at] |= part
                at = at[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)]
            shift += 8
        return out

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<qi", self.n, len(self.levels))]
        for chunks, bits, ranks in self.levels:
            parts += [struct.pack("<qqq", len(chunks), len(bits), len(ranks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> "Codes":
        n, count = struct.unpack_from("<qi", data, at)
        at += 12
        levels = []
        for _ in range(count):
            sizes = struct.unpack_from("<qqq", data, at)
            at += 24
            level = []
            for size, kind in zip(sizes, (np.uint8, np.uint8, "<u8")):
                level.append(np.frombuffer(data, kind, size, at))
                at += size * level[-1].itemsize
            levels.append(tuple(level))
        return cls(levels, n)


def segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The bytes of one segment. A null id is stored with its own mark."""
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    sizes = np.array([len(x) // 4 for x in ids], "<i8")
    return MAGIC + struct.pack("<q", len(ids)) + null.tobytes() + keys.tobytes() + sizes.tobytes() + Codes.of(np.frombuffer(b"".join(ids), "<u4")).to_bytes()


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """Document ids, numbers of ids and the codes of a segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    (n,) = struct.unpack_from("<q", data, 4)
    null, keys, sizes = np.frombuffer(data, np.uint8, n, 12), np.frombuffer(data, "<i8", n, 12 + n), np.frombuffer(data, "<i8", n, 12 + 9 * n)
    return [None if x else k for x, k in zip(null.tolist(), keys.tolist())], sizes, Codes.from_bytes(data, 12 + 17 * n)


def write_segments(docs: DataFrame, tokenizer: str, end_id: int = 0, segment_ids: int = SEGMENT) -> DataFrame:
    """The Parquet table of segments, in the shared folder, of the ids of whole texts with end_id after each.

    part and nth give segments in ascending doc_id order (null first, equal ids by text), first the
    number of ids before a segment in its part. A null text is empty: only end_id. Extra columns are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, of = TaskContext.get().partitionId(), encoder(tokenizer)
        keys, held, size, nth, first = [], [], 0, 0, 0
        schema = pa.schema({"part": pa.int32(), "nth": pa.int32(), "first": pa.int64(), "n_ids": pa.int64(), "data": pa.binary()})

        def out():
            return pa.RecordBatch.from_pylist([{"part": part, "nth": nth, "first": first, "n_ids": size, "data": segment(keys, held)}], schema)

        for batch in batches:
            ids_of = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for begin, texts in text_slices(batch, 4096):
                for key, ids in zip(ids_of[begin:], of.ids(texts)):
                    keys.append(key)
                    held.append(ids + end)
                    size += len(held[-1]) // 4
                    if size >= segment_ids:
                        yield out()
                        keys, held, nth, first, size = [], [], nth + 1, first + size, 0
        if held:
            yield out()

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(write, "part int, nth int, first long, n_ids long, data binary"), "dac")


def read_digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the segments' bytes."""

    def read(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for part, first, data in zip(pdf["part"], pdf["first"], pdf["data"]):
                keys, sizes, codes = read_segment(data)
                ends = np.cumsum(sizes)
                raw = memoryview(codes.all().tobytes())
                yield pd.DataFrame({
                    "part": part,
                    "doc_id": pd.array(keys, "Int64"),
                    "local": first + ends - sizes,
                    "n_tokens": sizes,
                    "ids_crc32": [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())],
                })

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = segments.groupBy("part").agg(F.sum("n_ids").alias("n_")).select("part", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    found = segments.select("part", "first", "data").mapInPandas(read, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(starts, "part").select("doc_id", (F.col("start_") + F.col("local")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def token_file_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_digests(write_segments(docs, tokenizer))
