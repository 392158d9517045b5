"""Stored results: named Parquet tables below a run key that depends on content and parameters.

A result becomes visible by the last step of its writing. An attempt writes its tables into a folder of its
own, which nobody looks for, and then publishes one line of the manifest by a rename. A job that dies before
that leaves the earlier run in place, and its remains are found by ``sweep``. Deletion works the other way
round: first a line says that an attempt is gone, then its folder goes.

    data/<run key>/<attempt>/<name>   tables
    manifest/lines/                   a JSON line for each published attempt
    manifest/removed/                 a JSON line for each attempt that was removed
    manifest/snapshots/               all lines of some time in one table; written by ``compact``

An attempt may be in a line and in a snapshot, or in two snapshots, and counts once, so a compaction
that dies half-way changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscope.functions.columns import col
from tabscope.plans.local import local_table
from tabscope.sources.files import Files

TTL_DAYS = 7
GRACE_HOURS = 24  # how long an attempt may be under way, and superseded manifest files stay for their readers
WHOLE_FILE_BYTES = 64 * 1024 * 1024  # files beyond it are hashed as lines in their order, not as one row
PRIMES = (2_147_483_647, 2_147_483_629)  # moduli of the hash of a sequence; products fit in 64 bits
BASES = (1_103_515_245, 1_812_433_253)
LINES = "attempt string, key string, version string, params string, stored_micros long, complete boolean, names array<string>"


def _below(base: str, *parts: str) -> str:
    return "/".join([base.rstrip("/"), *parts])


def _publish(
    spark: SparkSession, base: str, key: str, params: dict, version: str, attempt: str, names: list[str], complete: bool
) -> None:
    line = {
        "attempt": attempt,
        "key": key,
        "version": version,
        "params": json.dumps(params, sort_keys=True),
        "stored_micros": time.time_ns() // 1000,
        "complete": complete,
        "names": names,
    }
    Files(spark, base).publish(_below(base, "manifest", "lines", f"{attempt}.json"), json.dumps(line) + "\n")


def write_profile(
    results: dict[str, DataFrame],
    base: str,
    run_key: str,
    params: dict | None = None,
    version: str = "",
    complete: bool = True,
) -> list[str]:
    """All results of a run, visible together once the last is written. Returns their folders."""
    attempt = uuid.uuid4().hex
    paths = []
    for name, df in results.items():
        paths.append(_below(base, "data", run_key, attempt, name))
        df.write.parquet(paths[-1])
    for df in results.values():
        _publish(df.sparkSession, base, run_key, params or {}, version, attempt, list(results), complete)
        break
    return paths


def write_artifact(df: DataFrame, base: str, run_key: str, name: str) -> str:
    """One result of a run that is not complete yet; it takes the place of an earlier one of that name."""
    return write_profile({name: df}, base, run_key, complete=False)[0]


def _read_or_none(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _snapshots(files: Files, base: str) -> list[str]:
    """Finished snapshots, the newest last: their names begin with the time of writing."""
    found = files.list(_below(base, "manifest", "snapshots"))
    return sorted(e.path for e in found if e.folder and files.exists(f"{e.path}/_SUCCESS"))


def _removed(spark: SparkSession, base: str) -> DataFrame:
    read = spark.read.schema("attempt string")
    found = _read_or_none(lambda: read.json(_below(base, "manifest", "removed")))
    return local_table(spark, [], "attempt string") if found is None else found


def attempts(spark: SparkSession, base: str) -> DataFrame:
    """Every published attempt that was not removed, one row each."""
    found = _read_or_none(lambda: spark.read.schema(LINES).json(_below(base, "manifest", "lines")))
    rows = local_table(spark, [], LINES) if found is None else found
    snapshots = _snapshots(Files(spark, base), base)
    if snapshots:
        rows = rows.unionByName(spark.read.schema(LINES).parquet(snapshots[-1]))
    return rows.join(_removed(spark, base), "attempt", "left_anti").dropDuplicates(["attempt"])


def load_artifact(spark: SparkSession, base: str, run_key: str, name: str) -> DataFrame | None:
    """The result of that name in its newest published attempt, or None if there is none."""
    own = attempts(spark, base).filter((F.col("key") == run_key) & F.array_contains("names", name))
    newest = own.orderBy(F.desc("stored_micros"), "attempt").select("attempt").first()
    if newest is None:
        return None
    return _read_or_none(lambda: spark.read.parquet(_below(base, "data", run_key, newest["attempt"], name)))


def _order_free(hashes: DataFrame) -> str:
    """One text from any number of 64-bit hashes, whatever their order."""
    h = F.col("h")
    row = hashes.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(h.cast("decimal(38,0)")).alias("total"),
        F.bit_xor(F.xxhash64(h)).alias("mixed"),
    ).first()
    return f"{row['n']}|{row['total']}|{row['mixed']}"


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo the prime."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def _sequence_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, then for each modulus the hash of the lines in their order and the power that
    shifts what stands before them) from consecutive rows (file, start, h)."""
    for batch in batches:
        file, start, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        first = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (start[1:] != start[:-1])]) if len(h) else []
        rows = []
        for s, e in zip(first, [*first[1:], len(h)]):
            row = [int(file[s]), int(start[s])]
            for base, prime in zip(BASES, PRIMES):
                terms = h[s:e].view(np.uint64) % np.uint64(prime) * _powers(base, prime, e - s)[::-1] % np.uint64(prime)
                row += [int(terms.sum() % np.uint64(prime)), pow(base, int(e - s), prime)]
            rows.append(row)
        columns = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["file", "start", "a", "a_shift", "b", "b_shift"]
        )


def _file_hashes_by_line(lines: DataFrame) -> DataFrame:
    """One hash for each file of a text source, of its length and its lines in their order.

    Sequence hashes of parts join into that of the whole, so it does not matter where Spark splits a file.
    """
    rows = lines.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.xxhash64(F.col("value").cast("binary"), "_metadata.file_size").alias("h"),
    )
    parts = rows.mapInArrow(
        _sequence_hashes, "file long, start long, a long, a_shift long, b long, b_shift long"
    )
    # A task reads a split from its start on: the parts of one split keep their order by their number.
    numbered = parts.withColumn("no", F.monotonically_increasing_id())
    listed = numbered.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("start", "no", "a", "a_shift", "b", "b_shift"))).alias("parts")
    )

    def joined(name: str, prime: int):
        def add(total, part):
            return (total * part[f"{name}_shift"] + part[name]) % F.lit(prime)

        return F.aggregate("parts", F.lit(1).cast("long"), add)

    return listed.select(F.xxhash64(joined("a", PRIMES[0]), joined("b", PRIMES[1])).alias("h"))


def content_digest(spark: SparkSession, path: str) -> str:
    """A digest of the bytes at a path, not of the path or the order of files.

    Files that fit in a row are hashed whole on the executors. Each larger one is hashed by its length
    and its lines in their order, as Spark splits it, so no task has to hold a file.
    """
    files = spark.read.format("binaryFile").load(path)
    whole = files.filter(F.col("length") <= WHOLE_FILE_BYTES)
    lines = spark.read.option("lineSep", "\n").text(path)
    large = lines.filter(F.col("_metadata.file_size") > WHOLE_FILE_BYTES)
    return _order_free(
        whole.select(F.xxhash64(F.sha2("content", 256)).alias("h")).unionAll(_file_hashes_by_line(large))
    )


def table_digest(df: DataFrame) -> str:
    """A digest of the rows of a table, whatever their order."""
    return _order_free(df.select(F.xxhash64(*[col(c) for c in df.columns]).alias("h")))


def run_key(spark: SparkSession, digest: str, params: dict, version: str) -> str:
    """64 hex characters from content digest, sorted parameters and version."""
    text = "|".join([digest, json.dumps(params, sort_keys=True), version])
    return spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]


def store_run(spark: SparkSession, base: str, key: str, params: dict, version: str) -> None:
    """Mark a run as complete whose results were written one by one."""
    _publish(spark, base, key, params, version, uuid.uuid4().hex, [], True)


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """key, version, params, stored_at of the latest complete run of each key."""
    newest = F.max_by(F.struct("version", "params", "stored_micros"), F.struct("stored_micros", "attempt"))
    rows = attempts(spark, base).filter("complete").groupBy("key").agg(newest.alias("m"))
    return rows.select("key", "m.version", "m.params", F.timestamp_micros("m.stored_micros").alias("stored_at"))


def _too_old(ttl_days: float):
    """Whether stored_micros lies further back than the time to live."""
    return F.col("stored_micros") < F.lit(time.time_ns() // 1000 - int(ttl_days * 86_400_000_000))


def lookup_run(spark: SparkSession, base: str, key: str, ttl_days: float = TTL_DAYS) -> bool:
    """Whether a run of that key is stored and not too old."""
    own = attempts(spark, base).filter(F.col("complete") & (F.col("key") == key))
    return not own.filter(~_too_old(ttl_days)).isEmpty()


def expired_runs(spark: SparkSession, base: str, ttl_days: float = TTL_DAYS) -> DataFrame:
    """Runs older than the time to live; they are no longer found by ``lookup_run``."""
    stored = F.unix_micros("stored_at").alias("stored_micros")
    return manifest(spark, base).withColumn("stored_micros", stored).filter(_too_old(ttl_days)).drop("stored_micros")


def expire_runs(spark: SparkSession, base: str, ttl_days: float = TTL_DAYS) -> int:
    """Delete the attempts older than the time to live, of which the manifest lets go first. How many."""
    old = attempts(spark, base).filter(_too_old(ttl_days)).select("key", "attempt")
    return _remove(spark, base, old)


def drop_superseded(spark: SparkSession, base: str) -> int:
    """Delete attempts of which a later one of the same key has all results. How many."""
    later = Window.partitionBy("key").orderBy(F.desc("stored_micros"), "attempt")
    before = later.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.array_distinct(F.flatten(F.collect_list("names").over(before)))
    ranked = attempts(spark, base).withColumns(
        {"place": F.row_number().over(later), "seen": seen, "newer": F.max("complete").over(before)}
    )
    covered = (F.size(F.array_except("names", "seen")) == 0) & (~F.col("complete") | F.col("newer"))
    return _remove(spark, base, ranked.filter((F.col("place") > 1) & covered).select("key", "attempt"))


def _remove(spark: SparkSession, base: str, rows: DataFrame) -> int:
    files, n = Files(spark, base), 0
    for r in rows.toLocalIterator():  # names of folders
        files.publish(_below(base, "manifest", "removed", f"{r['attempt']}.json"), json.dumps({"attempt": r["attempt"]}) + "\n")
        files.delete(_below(base, "data", r["key"], r["attempt"]))
        files.delete_if_empty(_below(base, "data", r["key"]))
        n += 1
    return n


def sweep(spark: SparkSession, base: str, grace_hours: float = GRACE_HOURS) -> int:
    """Delete folders of attempts that were never published, or removed only in the manifest, and that
    nothing has touched for that long. How many."""
    files, limit = Files(spark, base), time.time() - grace_hours * 3600
    known = {r["attempt"] for r in attempts(spark, base).select("attempt").toLocalIterator()}
    n = 0
    for key in files.list(_below(base, "data")):
        own = files.list(key.path)
        gone = [e for e in own if e.name not in known and max([e.modified, *(x.modified for x in files.list(e.path))]) <= limit]
        for e in gone:
            files.delete(e.path)
        if len(gone) == len(own):
            files.delete_if_empty(key.path)
        n += len(gone)
    return n


def compact(spark: SparkSession, base: str, grace_hours: float = GRACE_HOURS) -> int:
    """Put all lines of the manifest into one table and delete what it replaces. How many files went.

    Files younger than the grace stay, for readers that have listed them. Of one store only one compaction may run
    at a time; writers and readers need not stop.
    """
    files, limit = Files(spark, base), time.time() - grace_hours * 3600
    lines = files.list(_below(base, "manifest", "lines"))
    old = _snapshots(files, base)
    removed = files.list(_below(base, "manifest", "removed"))
    rows = attempts(spark, base)
    # Only lines listed before may be deleted below, and all of them are in the table.
    rows.coalesce(1).write.parquet(_below(base, "manifest", "snapshots", f"{time.time_ns():020d}-{uuid.uuid4().hex}"))
    replaced = [e for e in lines if not e.folder and e.modified <= limit]
    for e in replaced:
        files.delete(e.path)
    stale = [e for e in files.list(_below(base, "manifest", "snapshots")) if e.path in old and e.modified <= limit]
    for e in stale:
        files.delete(e.path)
    n = len(replaced) + len(stale)
    # An attempt must not come back: its removal is forgotten only when nothing older names it.
    if len(replaced) == len(lines) and len(stale) == len(old):
        for e in removed:
            files.delete(e.path)
        n += len(removed)
    return n
