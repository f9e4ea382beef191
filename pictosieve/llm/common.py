"""What the operators of this subpackage share: reading tables and mapping blocks of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut  # noqa: F401  the operators take it from here
from .blocks import BLOCK_BYTES, Block, blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it if ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows that go to Python at once, at most: with texts of some thousand bytes, some MB.
ARROW_ROWS = 2000


def _small_batches(df: DataFrame) -> None:
    """Bound what a Python worker and its JVM hold of a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= ARROW_ROWS:
        df.sparkSession.conf.set(key, str(ARROW_ROWS))


def give_back() -> None:
    """What this worker has freed goes back to the system: it may wait for its next task beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_blocks(df: DataFrame, fn: Callable[[Block], dict[str, object]], added: str, text: str = "text", keep: Iterable[str] | None = None, most: int = BLOCK_BYTES) -> DataFrame:
    """``df``'s columns ``keep`` (all if None) with the columns that ``fn`` makes of each block.

    ``added`` is a DDL string of the new columns, whose names must not be among the kept.
    """
    _small_batches(df)
    keep = list(df.columns if keep is None else keep)
    read = list(dict.fromkeys([*keep, text]))
    new = T._parse_datatype_string(added)
    schema = T.StructType([*(df.schema[c] for c in keep), *new.fields])
    names, kinds = [f.name for f in schema.fields], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(f.dataType) for f in new.fields]
        for block in blocks(batches, text, most):
            made = fn(block)
            cols = [block.rows.column(block.rows.schema.get_field_index(c)) for c in keep]
            cols += [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], kind) for f, kind in zip(new.fields, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=names)
            del block, made, cols
        give_back()

    return df.select(*(_quoted(c) for c in read)).mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[Block], Iterable[dict[str, object]]], schema: str, text: str = "text", read: Iterable[str] = (), most: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``schema`` that ``fn`` makes of each block of ``df``; a dict has the columns of some rows."""
    _small_batches(df)
    kind = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for block in blocks(batches, text, most):
            for made in fn(block):
                yield pa.RecordBatch.from_arrays([x if isinstance(x := made[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)
            del block
        give_back()

    return df.select(*(_quoted(c) for c in dict.fromkeys([*read, text]))).mapInArrow(run, kind)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def column(block: Block, name: str) -> pa.Array:
    return block.rows.column(block.rows.schema.get_field_index(name))


def crc32_mod(id_column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % n
