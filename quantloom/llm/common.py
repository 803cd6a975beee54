"""Small helpers shared by the corpus operators: table scans, text expressions, settings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Upper- and lower-case ASCII letters; only these are folded.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


#: Rows whose results are held at a time.
ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def discard(*staged: DataFrame) -> None:
    """Delete the folders of staged tables that nothing reads any more."""
    for df in staged:
        files = df.inputFiles()
        if files:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def size_of(text: Column) -> Column:
    """Number of runs of characters other than blank, tab .. carriage return; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit(key: Column, salt: str) -> Column:
    """A number in (0, 1) that depends only on ``key`` and ``salt``: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged; ``lower`` does the same to texts of one byte per character, faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def add_columns(df: DataFrame, inputs: str | list[str], fn, added: str, drop_inputs: bool = True) -> DataFrame:
    """Append columns that Python computes per row, batch by batch, without a shuffle.

    ``fn`` gets the input values of one row (None for null) and returns a tuple for the columns
    listed in ``added`` ("name type, ..."); all other columns pass through untouched as Arrow data.
    """
    inputs = [inputs] if isinstance(inputs, str) else inputs
    kept = [f for f in df.schema.fields if not (drop_inputs and f.name in inputs)]
    new = df.sparkSession.createDataFrame([], added).schema
    schema = StructType([*kept, *new.fields])
    names = [f.name for f in kept]
    types = to_arrow_schema(new)

    def run(batches):
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            rows = [fn(*values) for values in zip(*(b.column(c).to_pylist() for c in inputs))]
            columns = zip(*rows) if rows else [[] for _ in types]
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + arrays, names=names + types.names)

    return df.mapInArrow(run, schema)
