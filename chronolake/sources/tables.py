"""Stored relations: keyed merges, and appends that add files only, exposed at once.

A relation is a list of folders; its pointer, a table of one row a commit, names the folders that count. A write makes new
folders and then appends to the pointer: readers see the old state or the new one, and a crash in between changes nothing.
Several relations that must change together share one pointer row. An append writes what arrived, whatever is stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, facts, ingest

POINTER = "sequence long, names map<string, array<string>>"


class Store:
    """Relations under one folder, which the driver and all executors share.

    Writes come from one writer at a time: a reader never sees half a write, but two writers could overwrite each other.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _states(self) -> tuple[int, dict[str, list[str]]]:
        """The sequence of the last commit, and the folders of each relation that count."""
        try:
            last = self.spark.read.schema(POINTER).parquet(f"{self.folder}/_pointer").orderBy(F.desc("sequence")).first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        return (last["sequence"], dict(last["names"])) if last else (0, {})

    def exists(self, name: str) -> bool:
        return name in self._states()[1]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{name}/{x}" for x in self._states()[1][name]])

    def _aligned(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` with the stored columns in their order; fails where it has others, or one that it lacks isn't nullable."""
        stored = self.read(name).limit(0)
        other = [x for x in rows.columns if x not in stored.columns]
        if other:
            raise ValueError(f"{name} has no column {', '.join(other)}")
        return stored.unionByName(rows, allowMissingColumns=True)

    def commit(self, replaced: dict[str, DataFrame] | None = None, added: dict[str, DataFrame] | None = None) -> None:
        """Writes relations anew, or more rows of them, then exposes all with one pointer row. Any failure exposes none."""
        written, more = {}, {}
        for name, rows in (replaced or {}).items():
            written[name] = [uuid.uuid4().hex]
            rows.write.parquet(f"{self.folder}/{name}/{written[name][0]}")
        for name, rows in (added or {}).items():
            more[name] = uuid.uuid4().hex
            (self._aligned(name, rows) if self.exists(name) else rows).write.parquet(f"{self.folder}/{name}/{more[name]}")
        sequence, names = self._states()
        names |= written | {name: [*names.get(name, []), folder] for name, folder in more.items()}
        self.spark.createDataFrame([(sequence + 1, names)], POINTER).coalesce(1).write.mode("append").parquet(f"{self.folder}/_pointer")

    def replace(self, **relations: DataFrame) -> None:
        self.commit(replaced=relations)

    def append(self, **relations: DataFrame) -> None:
        """Adds rows; nothing that is stored is read or written again."""
        self.commit(added=relations)

    def compact(self, name: str) -> None:
        """One folder in place of those of many appends."""
        self.commit(replaced={name: self.read(name)})

    def merged(self, name: str, arrived: DataFrame, keys: Sequence[str], keep_if_null: Sequence[str] = ()) -> DataFrame:
        """The relation with ``arrived`` in place of rows of the same keys; fails where a key arrives more than once."""
        once = arrived.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*arrived.columns)).alias("_row"))
        checked = ingest.refuse(once.withColumn("problem", F.when(F.col("_n") > 1, "key arrives more than once")), keys[0]).select("_row.*")
        return facts.upsert(self.read(name), checked, keys, keep_if_null) if self.exists(name) else checked

    def merge(self, name: str, arrived: DataFrame, keys: Sequence[str], keep_if_null: Sequence[str] = ()) -> None:
        self.replace(**{name: self.merged(name, arrived, keys, keep_if_null)})

    def validated(self, subject: dict[str, str], **relations: DataFrame) -> None:
        """``replace`` for rows with ``problem``: the first one that has any fails the whole write. ``subject`` names the
        column that the failure tells, by relation."""
        self.replace(**{name: ingest.refuse(rows, subject[name]) for name, rows in relations.items()})

    def append_versions(self, name: str, arrived: DataFrame, keys: Sequence[str]) -> None:
        """Appends what is new or changed as a next version, refusing keys that arrive more than once."""
        old = self.read(name) if self.exists(name) else arrived.withColumn("version", F.lit(0)).limit(0)
        self.append(**{name: ingest.refuse(ingest.append_versions(old, arrived, keys), keys[0])})

    def append_facts(self, name: str, arrived: DataFrame, retained: DataFrame) -> None:
        """Appends the next versions of facts; the first one that goes against the rules of ``ingest.fact_problems`` fails the
        write, and nothing changes. ``retained``: run_id, snapshot_id of the raw evidence that is kept."""
        empty = arrived.withColumns({"version": F.lit(0).cast("long"), "is_deleted": F.lit(False)}).limit(0)
        stored = self.read(name) if self.exists(name) else empty
        newest = asof.first_per(stored, ingest.FACT_KEY, asof.newest("version")).where("NOT is_deleted")
        fine = ingest.refuse(ingest.fact_problems(arrived, newest, retained), "ticker")
        self.append(**{name: ingest.fact_versions(stored, fine)})

    def refresh(self, name: str, arrived: DataFrame, keys: Sequence[str], owner: str | None = None) -> None:
        """``merge`` for a full refresh: fails where a stored key would be lost, or belongs to another owner."""
        if self.exists(name):
            problems = ingest.lost_keys(self.read(name), arrived, keys)
            if owner:
                problems = problems.unionByName(ingest.owner_conflicts(self.read(name), arrived, keys, owner))
            first = problems.limit(1).collect()
            if first:
                raise ValueError(f"{name}: {first[0]['problem']} {first[0][keys[0]]}")
        self.merge(name, arrived, keys)

    def quarantine(self, name: str, into: str, bad, reason: str) -> None:
        """Moves the rows that ``bad`` names to another relation: both change, or neither."""
        stays, goes = ingest.quarantined(self.read(name), bad, reason)
        self.commit(replaced={name: stays}, added={into: goes})

    def delete(self, name: str, gone, history: str | None = None) -> None:
        """Deletes rows; with ``history`` a tombstone of each is appended there in the same commit."""
        rows = self.read(name)
        marked = {history: ingest.tombstones(rows, gone)} if history else {}
        self.commit(replaced={name: rows.where(~F.coalesce(gone, F.lit(False)))}, added=marked)

    def logged(self, source: str, name: str, write: Callable[[], int], log: str = "ingest_log") -> None:
        """Runs a write and appends how it went (source, relation, n_rows, status, error) to the log, failures too."""
        status, error, n = "success", None, 0
        try:
            n = write()
            status = "success" if n else "warning"
        except Exception as failure:
            status, error = "failed", str(failure)[:500]
            raise
        finally:
            row = self.spark.createDataFrame([(source, name, n, status, error)], "source string, relation string, n_rows long, status string, error string")
            self.append(**{log: row})
