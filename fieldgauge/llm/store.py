"""Helpers shared by the corpus operators: tables, written intermediates, word counting."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import work_path

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def added(df: DataFrame, ddl: str, start, read: list[str], drop: tuple = ()) -> DataFrame:
    """``df`` without ``drop``, plus the columns of ``ddl``.

    ``start()`` runs once in a task and gives a function from the lists of the ``read`` columns' values in a batch to a dict of new
    columns. Other columns pass as they are, so that null or large numbers keep their type and value.
    """
    new = StructType.fromDDL(ddl)
    carried = [c for c in df.columns if c not in drop]
    schema = StructType([*[df.schema[c] for c in carried], *new.fields])
    kinds = to_arrow_schema(new)

    def run(batches):
        work = start()
        for b in batches:
            got = work(*[b.column(c).to_pylist() for c in read])
            columns = [pa.array(got[f.name], type=f.type, from_pandas=True) for f in kinds]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], *columns], names=schema.names)

    return df.mapInArrow(run, schema)
