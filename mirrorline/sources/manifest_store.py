"""The stored manifest: versioned snapshots behind one commit record.

A manifest is four tables: ``entries`` (saved files), ``visited`` and ``found``
(URLs captured and URLs linked to) and ``runs``. A version consists of a base
folder per table and, for entries, visited and found, some delta folders beside
it. Folders are written under names of their own and never changed; then one
record in ``commits`` names those that make up the version. That record is a
single file put in place by a rename, so a reader sees the version before or
the version after, and a run that dies halfway leaves nothing but unnamed
folders.

``append`` adds a round as deltas; after ``COMPACT_AFTER`` of them it folds them
into a new base, so reading costs the live rows and a bounded number of deltas,
not the history. A round is named by its ``round_id``: one that is committed
already (a replayed micro-batch) changes nothing, also when it was replayed
while its deltas were being folded.

One writer at a time; readers need no lock, because folders of earlier versions
stay.
"""

from __future__ import annotations

import uuid
import warnings
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT_AFTER = 4

URLS = "site string, url string"
SCHEMAS = {
    "entries": "site string, url string, path string, size bigint, hash string, mtime string, rtype string, out_hash string, seq bigint",
    "visited": URLS, "found": URLS,
    "runs": "site string, version int, start_url string, created_at string, updated_at string",
}
_COMMIT = "version bigint, round_id bigint, bases map<string,string>, deltas map<string,array<string>>"


def fold(name: str, rows: DataFrame) -> DataFrame:
    """Live rows out of rows of several rounds."""
    from ..operators.manifest import manifest_record_rows
    if name == "entries":
        return manifest_record_rows(rows)
    return rows.distinct()


class ManifestStore:
    """Versions of the manifest under a folder. ``fresh`` ignores what is stored."""

    def __init__(self, spark: SparkSession, path: str, fresh: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        self._fresh = fresh

    def last(self):
        """The newest commit that can be read, or None. Records that cannot be read are
        warned about; without any, the manifest counts as empty and a run starts afresh."""
        if self._fresh:
            return None
        try:
            commits = (self.spark.read.schema(_COMMIT + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(f"{self.path}/commits"))
        except PySparkException:  # no folder: nothing was ever committed
            return None
        bad = F.col("_bad").isNotNull() | F.col("version").isNull()
        if not commits.where(bad).isEmpty():
            warnings.warn(f"commit records of the manifest at {self.path} not used: they cannot be read", stacklevel=2)
        return commits.where(~bad).drop("_bad").orderBy(F.desc("version")).first()

    def _folders(self, commit, name: str) -> list[str]:
        if commit is None:
            return []
        base = (commit["bases"] or {}).get(name)
        return ([base] if base else []) + list((commit["deltas"] or {}).get(name, []))

    def _rows(self, commit, name: str) -> DataFrame:
        """All rows of a version's folders; unreadable ones count as none, with a warning."""
        folders = self._folders(commit, name)
        schema = SCHEMAS[name]
        empty = self.spark.createDataFrame([], schema)
        try:
            return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.path}/{f}") for f in folders], empty) if folders else empty
        except PySparkException as why:
            warnings.warn(f"{name} of the manifest at {self.path} not used: {str(why).splitlines()[0]}", stacklevel=2)
            return empty

    def read(self, name: str) -> DataFrame:
        """A table of the newest version."""
        commit = self.last()
        rows = self._rows(commit, name)
        return fold(name, rows) if len(self._folders(commit, name)) > 1 else rows

    def _write(self, rows: DataFrame, name: str) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        key = [c for c in ("site", "url") if c in rows.columns]
        (rows.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")])
         .repartitionByRange(*key).sortWithinPartitions(*key).write.parquet(f"{self.path}/{folder}"))
        return folder

    def _commit(self, version: int, round_id: int, bases: dict, deltas: dict) -> None:
        row = self.spark.createDataFrame([(version, round_id, bases, deltas)], _COMMIT)
        row.coalesce(1).write.mode("append").json(f"{self.path}/commits")
        self._fresh = False

    def write(self, round_id: int = -1, **tables: DataFrame) -> None:
        """A new version made of whole tables; those not given become empty."""
        last = self.last()
        bases = {name: self._write(rows, name) for name, rows in tables.items()}
        self._commit(last["version"] + 1 if last else 0, round_id, bases, {})

    def append(self, round_id: int, runs: DataFrame | None = None, **tables: DataFrame) -> bool:
        """A new version with a round's rows added (``runs`` is replaced). False if the
        round was committed before."""
        last = self.last()
        if last is not None and last["round_id"] >= round_id:
            return False
        bases = dict(last["bases"] or {}) if last else {}
        deltas = {k: list(v) for k, v in (last["deltas"] or {}).items()} if last else {}
        if runs is not None:
            bases["runs"] = self._write(runs, "runs")
        for name, rows in tables.items():
            deltas.setdefault(name, []).append(self._write(rows, name))
        version = last["version"] + 1 if last else 0
        self._commit(version, round_id, bases, deltas)
        for name in tables:
            if len(deltas[name]) >= COMPACT_AFTER:
                self.compact()
                break
        return True

    def compact(self) -> None:
        """Deltas folded into new bases: the same rows in a version of their own."""
        last = self.last()
        bases = dict(last["bases"] or {})
        for name in last["deltas"] or {}:
            bases[name] = self._write(fold(name, self._rows(last, name)), name)
        self._commit(last["version"] + 1, last["round_id"], bases, {})
