"""What the operators share: Arrow batches in, Arrow batches out, and narrow tables kept in the shared folder."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from palimpsest.session import kept, send_package

#: Bytes of text, each row's 1,000 bytes more, that are taken out of Arrow at a time; a longer text is alone. Spark bounds
#: the batches themselves by bytes (arrow.maxBytesPerBatch).
PIECE_BYTES = 4_000_000
#: Bytes of text that one call of a numpy kernel sees.
SLICE_BYTES = 2_000_000


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    send_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def column_bytes(batch: pa.RecordBatch, name: str | int) -> list[bytes]:
    """A string column, by name or place, as UTF-8; null counts as empty."""
    column = batch.column(name if isinstance(name, int) else batch.schema.names.index(name))
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], name: str | int = "text") -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most about PIECE_BYTES of the column named; empty batches give none."""
    for batch in batches:
        column = batch.column(name if isinstance(name, int) else batch.schema.names.index(name))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1000)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about `limit` bytes; a longer text is alone in its range."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores in front as it takes to be no column's, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    front = next("_" * n for n in range(1, len(taken) + 2) if not taken & {"_" * n + name.lower() for name in names})
    return [front + name for name in names]


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def annotate(df: DataFrame, text_col: str, fields: str, kernel: Callable[[], Callable[[list[bytes]], dict]], keep: str | None = None, replace: str | None = None) -> DataFrame:
    """Adds `fields`, which `kernel()` computes from the texts of each batch.

    A column of the same name, in upper or lower case, is replaced, as withColumn does. With `keep`, only the rows where that boolean field
    is true stay and no field is added; with `replace`, that field takes the place of the text and no other is added.
    """
    added = schema_of(fields)
    plain = keep is not None or replace is not None
    taken = {n.lower() for n in added.fieldNames()}
    left = [f for f in df.schema.fields if plain or f.name.lower() not in taken]
    schema = T.StructType(left if plain else left + added.fields)
    names, new = [f.name for f in left], added.fieldNames()
    kinds = {f.name: to_arrow_type(f.dataType) for f in added.fields}
    read = list(dict.fromkeys([*names, text_col]))
    at = read.index(text_col)
    df = df.select(*[F.col(f"`{n.replace('`', '``')}`") for n in read]).toDF(*[f"c{i}" for i in range(len(read))])  # any name is safe inside
    send_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = kernel()
        for batch in pieces(batches, at):
            found = compute(column_bytes(batch, at))
            columns = batch.columns[: len(names)]
            if replace is not None:
                columns[at] = pa.array(found[replace], pa.string())
            elif keep is None:
                columns += [found[n].cast(kinds[n]) if isinstance(found[n], pa.Array) else pa.array(found[n], kinds[n]) for n in new]
            out = pa.RecordBatch.from_arrays(columns, names=names if plain else names + new)
            yield out.filter(pa.array(found[keep])) if keep is not None else out

    return df.mapInArrow(run, schema)


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    send_package(df.sparkSession)
    out = kept(df)
    gc.collect()
    return out


def ids_and_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator's query needs, so that no other column can clash with its results."""
    send_package(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
