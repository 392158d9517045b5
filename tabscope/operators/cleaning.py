"""Row and column preparation: duplicates, missing values, encodings and samples."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.columns import MISSING_LEVEL, RETAINED_SHARE, col, share
from tabscope.plans.counts import value_counts
from tabscope.plans.kinds import clean, infer_kinds, normalise
from tabscope.plans.local import local_table
from tabscope.plans.moments import collect_moments
from tabscope.plans.quantiles import exact_medians
from tabscope.plans.scratch import materialise

SAMPLE_ROWS = 50_000
CODES_PER_PART = 200_000
HELD_HASHES = 1_000_000  # hashes that rows share, sent to all tasks: 16 MB

normalise_missing = normalise
stringify_nested = normalise


def row_counts(df: DataFrame) -> DataFrame:
    """Distinct rows with how often each occurs (``copies``); NULL equals NULL.

    Copies are counted inside each task first, so a row that makes up a third of the table
    crosses the shuffle once per task.
    """
    data = normalise(df)
    return data.groupBy(*[col(c) for c in data.columns]).agg(F.count(F.lit(1)).alias("copies"))


def _row_hashes(data: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row, one of them after the places of its NULLs, which a hash passes over."""
    columns = [col(c) for c in data.columns]
    empty = [F.when(c.isNull(), F.lit(1 << i % 62)).otherwise(0).cast("long") for i, c in enumerate(columns)]
    places = [reduce(Column.__add__, empty[i : i + 62]) for i in range(0, len(empty), 62)]
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(*places, *columns).alias("h2")]


def _distinct_rows(data: DataFrame, n_rows: int) -> int:
    """How many different rows there are. Only hashes are shuffled, and in full only rows whose hashes meet.

    Rows of different hashes differ; rows of equal hashes are compared as they are, so the result is exact.
    Where more than ``HELD_HASHES`` hashes are met more than once, most rows are copies, and all are compared.
    """
    hashed = data.select(*_row_hashes(data)).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    met = materialise(hashed.filter("n > 1"), "met-hashes")
    size = met.agg(F.count(F.lit(1)).alias("hashes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if not size["hashes"]:
        return n_rows
    if size["hashes"] > HELD_HASHES:
        return row_counts(data).count()
    names = [f"c{i}" for i in range(len(data.columns))]
    rows = data.select(*[col(c).alias(n) for c, n in zip(data.columns, names)], *_row_hashes(data))
    again = rows.join(F.broadcast(met.select("h1", "h2")), ["h1", "h2"], "left_semi")
    return n_rows - size["rows"] + again.select(*names).distinct().count()


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return normalise(df).dropDuplicates()


def duplicate_summary(df: DataFrame) -> DataFrame:
    """One row: n_rows, distinct_rows, duplicate_count, duplicate_share (of the original rows)."""
    data = normalise(df)
    n = data.count()
    distinct = _distinct_rows(data, n) if data.columns else min(n, 1)
    return local_table(
        df.sparkSession,
        [(n, distinct, n - distinct, (n - distinct) / n if n else 0.0)],
        "n_rows long, distinct_rows long, duplicate_count long, duplicate_share double",
    )


def reclassify_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Turn confirmed numeric columns into text: '1', never '1.0', where all values are whole."""
    numeric = [c for c in infer_kinds(df).numeric if c in columns]
    if not numeric:
        return df
    whole = collect_moments(df, numeric)
    data = normalise(df)
    out = {}
    for c in numeric:
        x = col(c)
        is_whole = whole[c]["count"] > 0 and whole[c]["all_integer"]
        out[c] = (x.cast("long") if is_whole else x.cast("double")).cast("string")
    return data.withColumns(out)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to double; what does not parse becomes NULL."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in columns})


def _fixed_width(dtype: T.DataType) -> int:
    widths = {
        T.BooleanType: 1,
        T.ByteType: 1,
        T.ShortType: 2,
        T.IntegerType: 4,
        T.FloatType: 4,
        T.DateType: 4,
    }
    return widths.get(type(dtype), 8)


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, memory_mb (3 dp), dtypes, duplicate_count.

    The size is that of the plain values: fixed widths plus the bytes of text.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    nested = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    ]
    fixed = sum(
        _fixed_width(f.dataType) for f in df.schema.fields if f.name not in text and f.name not in nested
    )
    data = normalise(df)
    sized = [F.coalesce(F.octet_length(col(c)), F.lit(0)) for c in text + nested]
    row_bytes = reduce(lambda a, b: a + b, sized, F.lit(fixed)).cast("long")
    counted = (
        data.groupBy(*[col(c) for c in data.columns])
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(
            F.sum("copies").alias("n_rows"),
            F.sum(F.col("copies") - 1).alias("duplicate_count"),
            F.sum(F.col("copies") * row_bytes).alias("bytes"),
        )
    )
    dtypes = F.create_map(
        *[F.lit(v) for f in df.schema.fields for v in (f.name, f.dataType.simpleString())]
    )
    zero = F.lit(0).cast("long")
    return counted.select(
        F.coalesce("n_rows", zero).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.round(F.coalesce("bytes", zero) / F.lit(1e6), 3).alias("memory_mb"),
        dtypes.alias("dtypes"),
        F.coalesce("duplicate_count", zero).alias("duplicate_count"),
    )


def _all_present(columns: list[str]) -> Column:
    return reduce(and_, [col(c).isNotNull() for c in columns], F.lit(True))


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    data = normalise(df)
    return data.dropna(subset=columns or data.columns)


def retained_fraction(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: n_rows, n_complete, retained (share of rows without NULL in the columns)."""
    names = columns or df.columns
    return (
        clean(df, names)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count(F.when(_all_present(names), 1)).alias("n_complete"),
        )
        .withColumn("retained", F.coalesce(share(F.col("n_complete"), F.col("n_rows")), F.lit(0.0)))
    )


def apply_missingness_strategy(
    df: DataFrame,
    target: str,
    features: list[str] | None = None,
    retained_min: float = RETAINED_SHARE,
    encoded: list[str] | tuple[str, ...] = (),
    keep: list[str] | tuple[str, ...] = (),
) -> tuple[DataFrame, str]:
    """Rows for the association analysis and the strategy as text.

    Only features and target are looked at; columns in ``keep`` travel along untouched.

    Complete cases when enough rows survive; otherwise categorical NULLs become a level of
    their own, numeric NULLs the column mean, and rows without target go.
    """
    kinds = infer_kinds(df, encoded).without(target, *keep)
    numeric = [c for c in kinds.numeric if features is None or c in features]
    categorical = [c for c in kinds.categorical if features is None or c in features]
    names = [*numeric, *categorical, target]
    data = clean(df, [*names, *keep])
    data = data.withColumns({c: col(c).cast("string") for c in categorical})
    counts = data.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(_all_present(names), 1)).alias("complete"),
        F.count(col(target)).alias("with_target"),
        *[F.avg(col(c)).alias(f"mean_{i}") for i, c in enumerate(numeric)],
    ).first()
    n = max(counts["n"], 1)
    if counts["complete"] / n >= retained_min:
        kept, label = counts["complete"], "complete-case"
        rows = data.dropna(subset=names)
    else:
        kept, label = counts["with_target"], f"imputed ({MISSING_LEVEL}+mean)"
        rows = data.dropna(subset=[target]).fillna(MISSING_LEVEL, subset=categorical)
        rows = rows.withColumns(
            {
                c: F.coalesce(col(c).cast("double"), F.lit(counts[f"mean_{i}"] or 0.0))
                for i, c in enumerate(numeric)
            }
        )
    return rows, f"{label}: N={kept:,}, {kept / n * 100:.1f}% retained"


def fill_categorical_missing(
    df: DataFrame, target: str | None = None, retained_min: float = RETAINED_SHARE
) -> DataFrame:
    """Give categorical NULLs a level of their own where too few complete rows would remain."""
    kinds = infer_kinds(df)
    names = list(dict.fromkeys([*kinds.categorical, *kinds.numeric, *([target] if target else [])]))
    data = normalise(df)
    if not names or not kinds.categorical:
        return data
    if retained_fraction(df, names).first()["retained"] < retained_min:
        data = data.fillna(MISSING_LEVEL, subset=kinds.categorical)
    return data


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): codes 0..k-1 in value order.

    The values are dealt by range into parts of about ``CODES_PER_PART``, whatever they look like,
    and written down; they are numbered inside their part and shifted by the parts before it.
    """
    values = materialise(value_counts(df, columns).select("column", "value"), "values")
    parts = max(1, -(-values.count() // CODES_PER_PART))
    dealt = values.repartitionByRange(parts, "column", "value").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "codes")
    below = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy("column", "part")
        .agg(F.count(F.lit(1)).alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(below), F.lit(0)))
        .select("column", "part", "before")
    )
    inside = Window.partitionBy("column", "part").orderBy("value")
    return (
        dealt.withColumn("place", F.row_number().over(inside))
        .join(before, ["column", "part"])
        .select("column", "value", (F.col("before") + F.col("place") - 1).cast("long").alias("code"))
    )


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each category column by its code; NULL stays NULL.

    The code tables are joined without a hint: adaptive execution broadcasts the ones whose
    measured size is small and shuffles the others.
    """
    out = normalise(df)
    codes = label_codes(df, columns)
    for c in columns:
        table = codes.filter(F.col("column") == c).select(
            F.col("value").alias("__value"), F.col("code").alias("__code")
        )
        out = (
            out.join(table, col(c).cast("string") == F.col("__value"), "left")
            .withColumn(c, F.col("__code"))
            .drop("__value", "__code")
        )
    return out


def median_fill(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or infer_kinds(df).numeric
    medians = exact_medians(df, names)
    return normalise(df).withColumns(
        {c: F.coalesce(col(c).cast("double"), F.lit(medians[c] or 0.0)) for c in names}
    )


def row_digest(columns: list[Column]) -> Column:
    """md5 of the given values. NULL differs from any text, and values from their neighbours: in texts, bars
    and backslashes are written with a backslash before them."""

    def part(c: Column) -> Column:
        plain = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.coalesce(plain, F.lit("\\N"))

    return F.md5(F.concat_ws("|", *[part(c) for c in columns]).cast("binary"))


def _digest_share(digest: Column) -> Column:
    """The digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def stratified_sample(
    df: DataFrame,
    target: str | None = None,
    n: int = SAMPLE_ROWS,
    key: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """n rows that keep the class shares of ``target`` (uniform where target is None).

    Rows are taken in the order of a digest of their key, so the sample does not depend on
    the partitioning or on a retried task. ``key`` should identify a row; all columns by
    default, which fits rows without copies (``drop_duplicate_rows``). A first cut on the
    digest leaves about twice the rows wanted, and only those are ranked.
    """
    keys = [col(c) for c in (key or df.columns)]
    digest = row_digest([F.lit(seed), *keys])
    if target is not None:
        classes = df.groupBy(col(target).alias("__class")).agg(F.count(F.lit(1)).alias("__size"))
        shape = classes.agg(
            F.sum("__size").alias("rows"), F.count("*").alias("k"), F.min("__size").alias("least")
        ).first()
        # Shares cannot be kept with one-row classes or more classes than rows wanted.
        if shape["rows"] is None or shape["rows"] <= n:
            return df
        if shape["k"] > n or shape["least"] < 2:
            return stratified_sample(df, None, n, key, seed)
    else:
        classes = df.agg(F.count(F.lit(1)).alias("__size")).withColumn("__class", F.lit(0))
        rows = classes.first()["__size"]
        if rows <= n:
            return df
        shape = {"rows": rows}
    # At most n classes are left here, so this table is small enough to rank in one task.
    exact = F.col("__size") * n / F.lit(float(shape["rows"]))
    left_over = Window.partitionBy(F.lit(0)).orderBy(F.desc("__part"), F.asc("__class"))
    quotas = (
        classes.withColumn("__floor", F.floor(exact))
        .withColumn("__part", exact - F.col("__floor"))
        .withColumn("__given", F.sum("__floor").over(Window.partitionBy(F.lit(0))))
        .withColumn("__place", F.row_number().over(left_over))
        .withColumn(
            "__quota",
            F.col("__floor") + F.when(F.col("__place") <= n - F.col("__given"), 1).otherwise(0),
        )
        .withColumn(
            "__cut", F.least(F.lit(1.0), (F.col("__quota") * 2 + 1000) / F.col("__size").cast("double"))
        )
        .select("__class", "__quota", "__cut")
    )
    data = df.withColumn("__digest", digest)
    klass = col(target) if target is not None else F.lit(0)
    # The class itself may be NULL, and NULL is a class of its own here.
    tagged = data.join(
        F.broadcast(quotas), klass.eqNullSafe(F.col("__class")), "inner"
    )
    near = tagged.filter(_digest_share(F.col("__digest")) < F.col("__cut"))
    order = Window.partitionBy("__class").orderBy("__digest")
    # The second condition has a fixed limit, which Spark applies per task before the shuffle:
    # rows with one and the same key cannot pile up in the task that ranks them.
    ranked = near.withColumn("__rank", F.row_number().over(order)).filter(
        (F.col("__rank") <= F.col("__quota")) & (F.col("__rank") <= n)
    )
    return ranked.drop("__class", "__quota", "__cut", "__digest", "__rank")
