"""Documents dealt into blocks that several steps of a plan read.

A step that has to meet its documents again after a shuffle (to use answers that
other tasks computed) reads blocks: the documents whose key hashes to a number.
A block is some megabytes of text, so a task can hold it, and no key decides its
size. The rows of a chunk that go to one block travel as one compressed Arrow
stream; the exchange by block is the only time that texts are shuffled, and all
steps of a plan share it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusguard.llm.memory import release

BLOCK_BYTES = 8 << 20
#: What a row counts besides its text when blocks are dealt.
ROW_BYTES = 64


def with_given(columns: str, rows: DataFrame) -> StructType:
    """The columns of a DDL string and then ``given`` of ``rows``, as nullable as it is."""
    return StructType([*StructType.fromDDL(columns), rows.schema["given"]])


def as_stream(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write(table)
    return sink.getvalue()


def from_streams(column: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in column])


def deal(docs: DataFrame, n_blocks: int) -> DataFrame:
    """``docs(key, text, ...)`` → ``(block int, data binary)``. Rows are dealt by
    key, text and the partition they are in, so that no key, and no row that is
    repeated or null in many partitions, makes a large block. A task that runs
    again deals as before."""
    key, text = docs.columns[:2]
    block = F.pmod(F.xxhash64(key, text, F.spark_partition_id()), F.lit(n_blocks))
    numbered = docs.select(block.cast("int").alias("_block"), F.struct(*docs.columns).alias("_row"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(0).to_numpy()
            rows = pa.RecordBatch.from_struct_array(batch.column(1))
            order = np.argsort(number, kind="stable")
            sorted_rows, number = rows.take(pa.array(order)), number[order]
            first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            ends = np.concatenate([first[1:], [len(number)]])
            data = [as_stream(sorted_rows.slice(a, b - a)) for a, b in zip(first, ends, strict=True)]
            out = pa.RecordBatch.from_arrays([pa.array(number[first], pa.int32()), pa.array(data, pa.binary())], ["block", "data"])
            del rows, sorted_rows, data
            release()
            yield out

    return numbered.mapInArrow(cut, "block int, data binary")
