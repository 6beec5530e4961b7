"""Exact deduplication by Grace hashing.

Records are dealt into partitions by content digest (Spark's shuffle files are the first level of spill files). A task
whose partition does not fit its memory budget deals it again, by further digest digits, into private scratch files,
recursively, until each bucket fits an open-addressing table that compares complete content. Before the shuffle each
task folds its own copies, so that a text that makes up a third of all rows reaches its bucket once per flush and not
once per row. Membership then travels as narrow (id, digest) rows, joined with the groups by digest; each group is one
row on its side of that join, so adaptive execution can split a hot digest over many tasks.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.llm._session import bounded, prepare

#: Bytes that one table may hold, what an entry takes besides its content (objects, list places, slots), and the number
#: of scratch files of one level (a hexadecimal digit).
TABLE_BYTES, ENTRY_BYTES, FANOUT = 32 << 20, 256, 16

RECORD = pa.schema([("digest", pa.binary()), ("content", pa.large_binary()), ("keep", pa.int64()), ("copies", pa.int64())])


class ContentTable:
    """Open addressing with linear probing; two entries are one only if their complete contents are equal."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = np.full(slots, -1, np.int64)
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.keep: list[int | None] = []
        self.copies: list[int] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.digests)

    def _free_or_equal(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "big") & mask
        while (entry := self.slots[at]) >= 0:
            if self.digests[entry] == digest:
                if self.contents[entry] != content:
                    raise ValueError("two different contents have one SHA-256 digest")
                return at
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, content: bytes, keep: int | None, copies: int) -> None:
        at = self._free_or_equal(digest, content)
        entry = self.slots[at]
        if entry >= 0:
            if keep is not None and (self.keep[entry] is None or keep > self.keep[entry]):
                self.keep[entry] = keep
            self.copies[entry] += copies
            return
        self.slots[at] = len(self.digests)
        self.digests.append(digest)
        self.contents.append(content)
        self.keep.append(keep)
        self.copies.append(copies)
        self.bytes += len(content) + ENTRY_BYTES
        if 2 * len(self.digests) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for n, (d, c) in enumerate(zip(self.digests, self.contents)):
                self.slots[self._free_or_equal(d, c)] = n

    def rows(self) -> Iterator[tuple]:
        return zip(self.digests, self.contents, self.keep, self.copies)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), RECORD)], schema=RECORD)


def _batched(rows: Iterable[tuple], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1]) + ENTRY_BYTES
        if size >= most_bytes:
            yield _record_batch(held)
            held, size = [], 0
    if held:
        yield _record_batch(held)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _spilled(path: str) -> Iterator[pa.RecordBatch]:
    with pa.OSFile(path) as source, pa.ipc.open_stream(source) as stream:
        yield from stream


def grace(rows: Iterable[tuple], budget: int = TABLE_BYTES, level: int = 0) -> Iterator[tuple]:
    """(digest, keep, copies) of each distinct content; deals into scratch files what does not fit one table."""
    rows = iter(rows)
    table = ContentTable()
    for digest, content, keep, copies in rows:
        table.add(digest, content, keep, copies)
        if table.bytes > budget and len(table) > 1:
            break
    else:
        for digest, _, keep, copies in table.rows():
            yield digest, keep, copies
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as scratch:
        paths = [os.path.join(scratch, str(n)) for n in range(FANOUT)]
        held: list[list[tuple]] = [[] for _ in paths]
        sizes = [0] * FANOUT
        writers = [pa.ipc.new_stream(path, RECORD) for path in paths]

        def put(row: tuple) -> None:
            # the low bits choose the slot in a table, so the digits come from the front, after Spark's own use of a hash
            digit = row[0][level // 2] >> (0 if level % 2 else 4) & 15
            held[digit].append(row)
            sizes[digit] += len(row[1]) + ENTRY_BYTES
            if sizes[digit] >= budget // FANOUT:
                writers[digit].write_batch(_record_batch(held[digit]))
                held[digit].clear()
                sizes[digit] = 0

        for row in table.rows():
            put(row)
        del table
        for row in rows:
            put(row)
        for writer, rest in zip(writers, held):
            if rest:
                writer.write_batch(_record_batch(rest))
            writer.close()
        del held
        for path in paths:
            yield from grace(_rows(_spilled(path)), budget, level + 1)
            os.unlink(path)


def _normalised(column: pa.Array) -> list[bytes]:
    return pc.ascii_lower(column.fill_null("")).cast(pa.large_binary()).to_pylist()


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's own copies as one record, as far as a table of bounded size goes."""
    table = ContentTable()
    for batch in batches:
        for key, content in zip(batch.column(0).to_pylist(), _normalised(batch.column(1))):
            table.add(hashlib.sha256(content).digest(), content, key, 1)
            if table.bytes > TABLE_BYTES:
                yield from _batched(table.rows())
                table = ContentTable()
    yield from _batched(table.rows())


def _bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = grace(_rows(batches))
    done = False
    while not done:
        part = []
        for row in found:
            part.append(row)
            if len(part) == 10_000:
                break
        else:
            done = True
        if part:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*part), (pa.binary(), pa.int64(), pa.int64()))],
                names=["digest", "keep_id", "group_size"],
            )


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256(content).digest() for content in _normalised(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], names=["id", "digest"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row with the
    largest id stays, a null id being smaller than any other; of rows that repeat both id and text, exactly one stays.
    Ids are cast to BIGINT. Other columns are ignored. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    folded = rows.mapInArrow(bounded(_fold), "digest binary, content binary, keep bigint, copies bigint")
    groups = folded.repartition("digest").mapInArrow(bounded(_bucket), "digest binary, keep_id bigint, group_size bigint")
    members = rows.mapInArrow(bounded(_digests), "id bigint, digest binary")
    # of rows with one id and one text, the first stays
    nth = F.row_number().over(Window.partitionBy("digest", "id").orderBy(F.lit(0)))
    members = members.withColumn("nth", nth)
    found = members.join(groups, "digest")
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
