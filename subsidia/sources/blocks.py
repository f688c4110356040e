"""Pixel blocks as folders of .npy columns: a data source that reads a block a partition and skips by filters.

A stored table is a folder with a folder for each block, in that a .npy file for each column, and an index of the
blocks: their folder, rows, and each column's least and greatest value. The reader plans from the index alone. Columns
come from the schema that is asked for, so a scan opens the files of those only. Files are reached through
pyarrow.fs, by any address that it knows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .scratch import sent_along

INDEX = "_index.parquet"
#: Rows of a batch that a task hands to Spark, and rows after which a block goes on in a further folder.
BATCH_ROWS, BLOCK_ROWS = 1 << 16, 1 << 22
_KINDS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType)


@dataclass
class Block(InputPartition):
    folder: str
    rows: int


@dataclass
class Written(WriterCommitMessage):
    blocks: list[dict]


def may_hold(low, high, flt) -> bool:
    """Could a block whose values lie between low and high (None: unknown) hold a row that a filter lets through?"""
    at_least, at_most = (lambda v: high is None or high >= v), (lambda v: low is None or low <= v)
    values = flt.value if isinstance(flt, In) else (getattr(flt, "value", None),)
    if any(v is None or isinstance(v, float) and math.isnan(v) for v in values):
        return True
    if isinstance(flt, (EqualTo, In)):
        return any(at_least(v) and at_most(v) for v in values)
    (value,) = values
    if isinstance(flt, GreaterThan):
        return high is None or high > value
    if isinstance(flt, GreaterThanOrEqual):
        return at_least(value)
    if isinstance(flt, LessThan):
        return low is None or low < value
    return at_most(value) if isinstance(flt, LessThanOrEqual) else True


class BlockReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.names, self.filters = path, schema.names, []

    def pushFilters(self, filters):
        """All filters go back to Spark: blocks are skipped by them, rows are not."""
        self.filters = [f for f in filters if len(getattr(f, "attribute", ())) == 1]
        yield from filters

    def partitions(self) -> list[Block]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        known = pyarrow.parquet.ParquetFile(fs.open_input_file(f"{root}/{INDEX}")).schema_arrow.names
        able = [f for f in self.filters if f"lo {f.attribute[0]}" in known]
        wanted = dict.fromkeys(["folder", "rows", *(f"{side} {f.attribute[0]}" for f in able for side in ("lo", "hi"))])
        index = pyarrow.parquet.read_table(f"{root}/{INDEX}", filesystem=fs, columns=list(wanted)).to_pylist()
        return [Block(b["folder"], b["rows"]) for b in index if all(may_hold(b[f"lo {f.attribute[0]}"], b[f"hi {f.attribute[0]}"], f) for f in able)]

    def read(self, block: Block | None) -> Iterator[pa.RecordBatch]:
        if block is None:  # no block is left
            return
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)

        def column(name: str) -> tuple[np.ndarray, np.ndarray | None]:
            with fs.open_input_stream(f"{root}/{block.folder}/{name}.npy") as f:
                values = np.lib.format.read_array(f)
            nulls = f"{root}/{block.folder}/{name}.null.npy"
            if fs.get_file_info(nulls).type == pyarrow.fs.FileType.NotFound:
                return values, None
            with fs.open_input_stream(nulls) as f:
                return values, np.lib.format.read_array(f)

        columns = [column(name) for name in self.names]
        for lo in range(0, block.rows, BATCH_ROWS):
            cut = slice(lo, min(block.rows, lo + BATCH_ROWS))
            yield pa.RecordBatch.from_arrays([pa.array(v[cut], mask=None if m is None else m[cut]) for v, m in columns] or [pa.nulls(cut.stop - lo)], self.names or ["none"])


class BlockWriter(DataSourceArrowWriter):
    def __init__(self, path: str, by: str, names: list[str]):
        self.path, self.by, self.names = path, by, names

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """A folder for each stretch of rows with one value of the column that blocks are made by."""
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        done, held, size, own = [], [], 0, None

        def flush() -> None:
            nonlocal held, size
            if not held:
                return
            table, entry = pa.Table.from_batches(held).combine_chunks(), {"folder": f"block-{uuid.uuid4().hex}", "rows": size}
            fs.create_dir(f"{root}/{entry['folder']}")
            for name, column in zip(table.column_names, table.columns, strict=True):
                nulls = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
                kept = column.drop_null() if column.null_count else column
                if column.null_count:
                    column = column.fill_null(False if pa.types.is_boolean(column.type) else 0)
                values = column.to_numpy()
                for what, array in ((name, values), (f"{name}.null", nulls)):
                    if array is not None:
                        with fs.open_output_stream(f"{root}/{entry['folder']}/{what}.npy") as f:
                            np.lib.format.write_array(f, np.ascontiguousarray(array))
                least = greatest = None
                if len(kept):
                    found = kept.to_numpy()
                    whole = not np.isnan(found).any() if found.dtype.kind == "f" else True
                    # NaN is greater than all numbers to Spark
                    least, greatest = (np.nanmin(found).item() if whole or not np.isnan(found).all() else None), (found.max().item() if whole else None)
                entry |= {f"lo {name}": least, f"hi {name}": greatest}
            done.append(entry)
            held, size = [], 0

        for batch in batches:
            ids = batch.column(self.by).to_pylist()
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and (ids[lo] != own or size + hi - lo > BLOCK_ROWS):
                    flush()
                own = ids[lo]
                held.append(batch.slice(lo, hi - lo))
                size += hi - lo
        flush()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        blocks = [b for m in messages if m for b in m.blocks]
        columns = ["folder", "rows", *(f"{side} {n}" for n in self.names for side in ("lo", "hi"))]
        table = pa.table({c: [b[c] for b in blocks] for c in columns})
        fs.create_dir(root)
        pyarrow.parquet.write_table(table, f"{root}/{INDEX}", filesystem=fs)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        for b in [b for m in messages if m for b in m.blocks]:
            fs.delete_dir(f"{root}/{b['folder']}")


class BlockSource(DataSource):
    """format("npy_blocks"), option path; writing: option by, the column that blocks are made by."""

    @classmethod
    def name(cls) -> str:
        return "npy_blocks"

    def reader(self, schema: T.StructType) -> BlockReader:
        return BlockReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> BlockWriter:
        if odd := [f.name for f in schema.fields if not isinstance(f.dataType, _KINDS)]:
            raise TypeError(f"columns of blocks are numbers and booleans; these aren't: {', '.join(odd)}")
        return BlockWriter(self.options["path"], self.options["by"], schema.names)


sent_along(__name__)


def _ready(spark: SparkSession) -> None:
    spark.dataSource.register(BlockSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_blocks(pixels: DataFrame, path: str, by: str = "block_id") -> None:
    """Store numbers and booleans by blocks, anew. A null in by makes a block as other values do."""
    _ready(pixels.sparkSession)
    pixels.repartition(by).sortWithinPartitions(by).write.format("npy_blocks").option("by", by).mode("append").save(path)


def read_blocks(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The stored columns that schema names, a partition for each block that filters leave."""
    _ready(spark)
    return spark.read.format("npy_blocks").schema(schema).load(path)
