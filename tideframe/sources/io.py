"""Sources and sinks: Parquet and Arrow IPC files, in-memory frames, ranges."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from tideframe.operators.frame import TideFrame


class _Block(InputPartition):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block


def _open(path: str):
    fs, name = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
    return fs, name


def _plain(schema: pa.Schema) -> pa.Schema:
    """Nanosecond times become microseconds, the finest that Spark has."""
    return pa.schema([f.with_type(pa.timestamp("us")) if pa.types.is_timestamp(f.type) and f.type.tz is None else f for f in schema])


class _IpcReader(DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str]):
        self.paths, self.columns = paths, columns

    def partitions(self):
        out = []
        for p in self.paths:
            fs, name = _open(p)
            with fs.open_input_file(name) as f:
                out += [_Block(p, i) for i in range(pa.ipc.open_file(f).num_record_batches)]
        return out

    def read(self, partition: _Block):
        fs, name = _open(partition.path)
        with fs.open_input_file(name) as f:
            batch = pa.ipc.open_file(f).get_batch(partition.block)
        table = pa.Table.from_batches([batch]).select(self.columns)
        yield from table.cast(_plain(table.schema), safe=False).to_batches()


class IpcDataSource(DataSource):
    """Arrow IPC (Feather) files, one partition for each record batch: .format("tide_ipc").option("columns", "a,b").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "tide_ipc"

    def _paths(self) -> list[str]:
        fs, name = _open(self.options["path"])
        info = fs.get_file_info(name)
        if info.type != pa.fs.FileType.Directory:
            return [self.options["path"]]
        head = self.options["path"].split("://")[0] + "://" if "://" in self.options["path"] else ""
        return sorted(head + i.path for i in fs.get_file_info(pa.fs.FileSelector(name)) if i.is_file)

    def _columns(self) -> list[str]:
        fs, name = _open(self._paths()[0])
        with fs.open_input_file(name) as f:
            names = pa.ipc.open_file(f).schema.names
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return [names[int(c)] if c.lstrip("-").isdigit() else c for c in wanted] or names

    def schema(self) -> T.StructType:
        fs, name = _open(self._paths()[0])
        with fs.open_input_file(name) as f:
            full = pa.ipc.open_file(f).schema
        return from_arrow_schema(_plain(pa.schema([full.field(c) for c in self._columns()])))

    def reader(self, schema) -> DataSourceReader:
        return _IpcReader(self._paths(), self._columns())


def scan_ipc(spark: SparkSession, path: str, columns=None, **frame) -> TideFrame:
    """A lazy scan of Arrow IPC files; columns by name, index or negative index."""
    spark.dataSource.register(IpcDataSource)
    reader = spark.read.format("tide_ipc")
    if columns is not None:
        reader = reader.option("columns", ",".join(str(c) for c in ([columns] if isinstance(columns, (str, int)) else columns)))
    return TideFrame(reader.load(path), **frame)


read_ipc = scan_ipc


def write_ipc(df: DataFrame, path: str) -> None:
    """A bounded result as one Arrow IPC file, written by the driver; larger ones go to Parquet by df.write."""
    table = df.toArrow()
    fs, name = _open(path)
    with fs.open_output_stream(name) as f, pa.ipc.new_file(f, table.schema) as out:
        out.write_table(table)


def scan_parquet(spark: SparkSession, path: str, columns=None, **frame) -> TideFrame:
    df = spark.read.parquet(path)
    return TideFrame(df.select(*columns) if columns else df, **frame)


def frame(spark: SparkSession, data, columns: list[str] | None = None, order: str = "i", **named) -> TideFrame:
    """A small frame of a dict, a list of columns, or a pandas, polars or Arrow table; order names an added column of row
    places."""
    import pandas as pd

    if hasattr(data, "to_arrow"):
        data = data.to_arrow()
    if isinstance(data, pa.Table):
        data = data.to_pandas()
    if isinstance(data, (list, tuple)):
        data = {f"column_{i}": v for i, v in enumerate(data)}
    pdf = data.copy() if isinstance(data, pd.DataFrame) else pd.DataFrame({**(data or {}), **named})
    if columns:
        pdf.columns = columns
    if order not in pdf.columns:
        pdf[order] = range(len(pdf))
    for c in pdf.columns:
        if pd.api.types.is_datetime64_any_dtype(pdf[c]):
            pdf[c] = pdf[c].astype("datetime64[us]")
    df = spark.createDataFrame(pdf)
    df = df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if isinstance(f.dataType, T.TimestampType)})
    return TideFrame(df, order)


def arange(spark: SparkSession, start: float, end: float | None = None, step: float = 1.0, name: str = "value") -> TideFrame:
    """Numbers from start (or 0) to end, end not included."""
    start, end = (0.0, start) if end is None else (start, end)
    n = max(0, -int(-(end - start) // step))
    return TideFrame(spark.range(n).select(F.col("id").alias("i"), (F.lit(float(start)) + F.col("id") * float(step)).alias(name)), "i")


def full(spark: SparkSession, n: int, value, name: str = "value") -> TideFrame:
    return TideFrame(spark.range(n).select(F.col("id").alias("i"), F.lit(value).alias(name)), "i")
