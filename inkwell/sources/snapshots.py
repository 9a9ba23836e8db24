"""Publish a new state of several tables atomically.

The reference commits or rolls back a database transaction. Without a table
format, a batch job writes every changed table into a fresh folder
``<root>/snapshot=<N>/<Table>/`` and, last, a small commit record
``<root>/snapshot=<N>/_commit`` (JSON rows ``Snapshot, TableName, Path,
RowCount, Epoch``). Readers take the highest snapshot with a commit record,
so a job that fails before its commit leaves snapshot N-1 current, the same
outcome as a rollback. Unchanged tables are not copied: the commit record
points at the folders of the snapshots that wrote them. Append-only tables
(sales, sale lines) are published as an extra folder next to their earlier
ones, so a batch writes only its new rows. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from inkwell.schemas import PRIMARY_KEYS, SCHEMAS, VIEW_SCHEMAS
from inkwell.sources.tables import conform


_COMMIT_SCHEMA = "Snapshot INT, TableName STRING, Path STRING, RowCount LONG, Epoch LONG, Epochs MAP<STRING, LONG>"


REFUSED_SCHEMA = "Source STRING, RequestID LONG, Reason STRING"


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_COMMIT_SCHEMA).json(f"{root}/snapshot=*/_commit")
    except AnalysisException:
        return None


def current_snapshot(spark: SparkSession, root: str) -> tuple[int, dict[str, list[str]], int | None]:
    """(number, table -> folders, epoch) of the newest committed snapshot;
    (0, {}, None) when nothing was published yet."""
    commits = _commits(spark, root)
    if commits is None:
        return 0, {}, None
    newest = commits.agg(F.max("Snapshot")).first()[0]
    if newest is None:
        return 0, {}, None
    rows = commits.filter(F.col("Snapshot") == newest).collect()
    paths: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: r.Path):
        paths.setdefault(r.TableName, []).append(r.Path)
    epoch = max((r.Epoch for r in rows if r.Epoch is not None), default=None)
    return int(newest), paths, epoch


def last_epochs(spark: SparkSession, root: str) -> dict[str, int]:
    """Per source of batches, the last batch id the newest snapshot includes.
    Every commit carries the ids of all sources forward."""
    commits = _commits(spark, root)
    if commits is None:
        return {}
    newest = commits.agg(F.max_by("Epochs", "Snapshot")).first()[0]     # one small map
    return dict(newest or {})


def load_refused(spark: SparkSession, root: str) -> DataFrame:
    """Refused requests of all committed snapshots: Source, RequestID, Reason,
    snapshot. Folders of attempts that never committed are left out."""
    commits = _commits(spark, root)
    empty = spark.createDataFrame([], REFUSED_SCHEMA + ", snapshot INT")
    if commits is None:
        return empty
    try:
        rows = spark.read.option("basePath", root).schema(REFUSED_SCHEMA + ", snapshot INT").parquet(f"{root}/snapshot=*/refused")
    except AnalysisException:
        return empty
    done = commits.select(F.col("Snapshot").alias("_n")).distinct()
    return rows.join(done, F.col("snapshot") == F.col("_n"), "left_semi")


def load_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the newest committed snapshot, read with their schema."""
    _, paths, _ = current_snapshot(spark, root)
    return {name: spark.read.schema(SCHEMAS.get(name) or VIEW_SCHEMAS[name]).parquet(*p)
            for name, p in paths.items()}


# Tables stored in hash buckets (column, bucket count): a batch that changes
# a few stores rewrites only their buckets (``patched``), not the table.
BUCKETED: dict[str, tuple[str, int]] = {"Inventory": ("StoreCode", 64)}
_BUCKET = "ib"


def bucket_of(table: str) -> Column:
    col, n = BUCKETED[table]
    return F.pmod(F.hash(F.col(col)), F.lit(n))


def _bucket_id(path: str) -> int | None:
    tail = path.rstrip("/").rsplit("/", 1)[-1]
    return int(tail[len(_BUCKET) + 1:]) if tail.startswith(_BUCKET + "=") else None


def is_bucketed(paths: list[str]) -> bool:
    return bool(paths) and all(_bucket_id(p) is not None for p in paths)


def _write(spark: SparkSession, df: DataFrame, name: str, path: str) -> dict[str, int]:
    """Write one table (bucketed tables as ``ib=<k>`` folders); returns the
    written leaf folders with their row counts."""
    out = conform(df, name)
    # an uncommitted leftover of a failed attempt may exist: overwrite it
    if name in BUCKETED:
        # range on (bucket, key): a bucket holding a hot store is split over
        # several writer tasks; each task writes its buckets one after another
        keys = PRIMARY_KEYS[name]
        (out.withColumn(_BUCKET, bucket_of(name))
         .repartitionByRange(_BUCKET, *keys).sortWithinPartitions(_BUCKET, *keys)
         .write.mode("overwrite").partitionBy(_BUCKET).parquet(path))
        counts = spark.read.parquet(path).groupBy(_BUCKET).count().collect()   # <= bucket count rows
        return {f"{path}/{_BUCKET}={r[0]}": r[1] for r in counts}
    out.write.mode("overwrite").parquet(path)
    return {path: spark.read.parquet(path).count()}


def publish_snapshot(spark: SparkSession, root: str, changed: Mapping[str, DataFrame] | None = None,
                     appended: Mapping[str, DataFrame] | None = None,
                     patched: Mapping[str, tuple[DataFrame, list[int]]] | None = None,
                     epoch: int | None = None, source: str | None = None,
                     refused: DataFrame | None = None) -> int:
    """Write snapshot N+1 and commit it; returns N+1.

    ``changed`` tables replace their current contents; ``appended`` rows are
    added to their table; ``patched`` gives, for a bucketed table, the new
    rows of the listed buckets only (the other buckets keep their folders).
    Other tables keep their folders. Row counts of the written folders are
    recorded in the commit (the reference reports the affected row count).
    ``epoch`` marks the input batch of ``source`` that produced the snapshot
    (used to skip a batch a stream replays after a failure); each source
    counts its own batches. ``refused`` (RequestID, Reason) are the requests
    the batch refused, kept beside the tables (see ``load_refused``).
    """
    n, paths, _ = current_snapshot(spark, root)
    new = n + 1
    base = f"{root}/snapshot={new}"
    records = {k: list(v) for k, v in paths.items()}
    counts: dict[str, int] = {}
    for name, df in (changed or {}).items():
        written = _write(spark, df, name, f"{base}/{name}")
        records[name] = sorted(written)
        counts.update(written)
    for name, df in (appended or {}).items():
        written = _write(spark, df, name, f"{base}/{name}")
        records[name] = [*records.get(name, []), *sorted(written)]
        counts.update(written)
    for name, (df, buckets) in (patched or {}).items():
        if not is_bucketed(records.get(name, [])):
            raise ValueError(f"{name} is not stored in buckets; publish it as changed first")
        touched = set(buckets)
        written = _write(spark, df.filter(bucket_of(name).isin(sorted(touched))), name, f"{base}/{name}")
        kept = [p for p in records[name] if _bucket_id(p) not in touched]
        records[name] = sorted([*kept, *written])
        counts.update(written)
    if refused is not None:
        (refused.select(F.lit(source).alias("Source"), F.col("RequestID").cast("long"), "Reason")
         .write.mode("overwrite").parquet(f"{base}/refused"))
    epochs = last_epochs(spark, root) | ({} if epoch is None or source is None else {source: epoch})
    rows = [(new, name, p, counts.get(p), epoch, epochs) for name, ps in sorted(records.items()) for p in ps]
    commit = spark.createDataFrame(rows, _COMMIT_SCHEMA)
    commit.coalesce(1).write.mode("overwrite").json(f"{base}/_commit")
    return new


def compact_snapshot(spark: SparkSession, root: str, tables: tuple[str, ...] | None = None,
                     min_folders: int = 2) -> int | None:
    """Rewrite each table held in ``min_folders`` or more folders (appended
    batches) into one folder of a new snapshot, so reads stay one folder per
    table and the commit record stays short. Returns the new snapshot number,
    or None when nothing needed compaction."""
    _, paths, epoch = current_snapshot(spark, root)
    # bucketed tables are many folders by design (one per bucket): not compacted
    names = [n for n, p in paths.items()
             if len(p) >= min_folders and not is_bucketed(p) and (tables is None or n in tables)]
    if not names:
        return None
    current = load_snapshot(spark, root)
    return publish_snapshot(spark, root, changed={n: current[n] for n in names}, epoch=epoch, source=None)
