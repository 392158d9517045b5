"""Column kinds, and the one projection that every statistic starts from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.columns import col
from tabscope.plans.local import local_table

_FLOATS = (T.FloatType, T.DoubleType)
_NESTED = (T.StructType, T.ArrayType, T.MapType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass
class Kinds:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    encoded: list[str] = field(default_factory=list)

    def without(self, *names: str | None) -> "Kinds":
        def keep(cols):
            return [c for c in cols if c not in names]

        return Kinds(
            keep(self.numeric), keep(self.categorical), keep(self.datetime), keep(self.encoded)
        )


def infer_kinds(df: DataFrame, encoded: tuple[str, ...] | list[str] = ()) -> Kinds:
    """Kinds from the schema alone. Names in ``encoded`` that are numeric count as categorical."""
    kinds = Kinds()
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            if f.name in encoded:
                kinds.encoded.append(f.name)
            else:
                kinds.numeric.append(f.name)
        elif isinstance(f.dataType, _TIMES):
            kinds.datetime.append(f.name)
        else:
            kinds.categorical.append(f.name)
    kinds.categorical += kinds.encoded
    return kinds


def column_kinds(df: DataFrame, encoded: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """One row per column: position, column, dtype, kind, encoded."""
    kinds = infer_kinds(df, encoded)
    rows = [
        (
            i,
            f.name,
            f.dataType.simpleString(),
            "numeric"
            if f.name in kinds.numeric
            else "datetime"
            if f.name in kinds.datetime
            else "categorical",
            f.name in kinds.encoded,
        )
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return local_table(
        df.sparkSession,
        rows, "position int, column string, dtype string, kind string, encoded boolean"
    )


def normalise(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL, nested values JSON text, booleans text, decimals double.

    A projection only: Catalyst folds it into the scan and prunes what is not used.
    """
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, _FLOATS):
            d = c.cast("double")
            # NaN sorts above infinity, so one comparison leaves out both.
            out.append(F.when(F.abs(d) < F.lit(float("inf")), d).alias(f.name))
        elif isinstance(f.dataType, _NESTED):
            out.append(F.to_json(c).alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            out.append(c.cast("double").alias(f.name))
        elif isinstance(f.dataType, T.NumericType) or isinstance(f.dataType, _TIMES):
            out.append(c)
        elif isinstance(f.dataType, T.StringType):
            out.append(c)
        else:
            out.append(c.cast("string").alias(f.name))
    return df.select(*out)


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """The chosen columns, normalised."""
    return normalise(df.select(*[col(c) for c in columns]))
