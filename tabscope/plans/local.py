"""Result rows on the driver (one per column, pair or group) as a DataFrame."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_table(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """Arrow rows become a local relation: Catalyst folds what follows into it, without a job."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), struct)


def keep_rows(df: DataFrame) -> DataFrame:
    """Run a result with one row per column, pair or feature once, for several readers."""
    return local_table(df.sparkSession, df.collect(), df.schema)
