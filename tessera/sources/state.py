"""A state in versions, with a manifest that is put in place last.

A commit writes its rows to a folder that no reader knows of, then a manifest, under another name, and then gives that
its number by one rename. Readers take the manifest with the highest number and read the files that it names, so
what a writer left behind when it was killed is never seen, and two writers cannot both follow the same version. All
goes through Hadoop's file systems, as Spark's own writes do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.merges import snapshot_delta

#: Of the manifests' own layout; a reader refuses others.
FORMAT = 1


class StateConflict(RuntimeError):
    """Another writer has committed the next version first."""


class Duplicates(ValueError):
    """A key occurs more than once in a state."""


class VersionedState:
    """The state of a source in a folder: its versions, each whole, each with a key and a print for each row."""

    def __init__(self, spark: SparkSession, folder: str, source: str, key: str, print_: str):
        self.spark, self.folder, self.source, self.key, self.print = spark, folder.rstrip("/"), source, key, print_
        self._jvm = spark._jvm

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _system(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _text(self, path) -> str:
        stream = self._system().open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """The numbers of the committed versions, in order."""
        system, where = self._system(), self._path("manifests")
        names = [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version (the last one) consists of; None before the first."""
        known = self.versions()
        if not known:
            return None
        found = json.loads(self._text(self._path(f"manifests/{version or known[-1]}.json")))
        if found["format"] != FORMAT or found["source"] != self.source:
            raise ValueError(f"state of {found['source']} in format {found['format']}, not of {self.source} in {FORMAT}")
        return found

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (the last one); None before the first."""
        found = self.manifest(version)
        return found and self.spark.read.schema(found["schema"]).parquet(*(f"{self.folder}/{found['data']}/{f}" for f in found["files"]))

    def commit(self, rows: DataFrame) -> int:
        """Writes rows as the next version and returns its number. Keys that repeat are an error, and leave the state as it was."""
        before = self.manifest()
        number, data = (before["version"] if before else 0) + 1, f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{data}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{data}")
        twice = written.groupBy(self.key).count().filter("count > 1").limit(1).collect()
        if twice:
            raise Duplicates(f"{self.key} {twice[0][0]} occurs {twice[0]['count']} times")
        files = sorted(f.getPath().getName() for f in self._system().listStatus(self._path(data)) if f.getPath().getName().startswith("part-"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self._put({"format": FORMAT, "source": self.source, "version": number, "data": data, "files": files, "schema": schema, "rows": written.count()})
        return number

    def _put(self, manifest: dict) -> None:
        system, folder = self._system(), self._path("manifests")
        system.mkdirs(folder)
        own, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{manifest['version']}.json")
        stream = system.create(own, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        # a rename does not replace what is there
        if system.exists(final) or not system.rename(own, final):
            system.delete(own, False)
            raise StateConflict(f"version {manifest['version']} of {self.source} is there already")

    def delta(self, rows: DataFrame) -> DataFrame:
        """Key and ADDED, CHANGED, REMOVED or UNCHANGED of rows against the last version; before the first all are ADDED."""
        old = self.read()
        old = rows.filter(F.lit(False)) if old is None else old
        return snapshot_delta(old, rows, self.key, self.print)

    def forget(self, keep: int) -> None:
        """Drops all but the last `keep` versions, and data that no manifest names (of writers that were killed; not while one writes)."""
        system, known = self._system(), self.versions()
        for n in known[: max(0, len(known) - keep)]:
            system.delete(self._path(f"manifests/{n}.json"), False)
        named = {self.manifest(n)["data"].removeprefix("data/") for n in known[-keep:]} if keep else set()
        if system.exists(self._path("data")):
            for f in system.listStatus(self._path("data")):
                if f.getPath().getName() not in named:
                    system.delete(f.getPath(), True)


class Ledger(VersionedState):
    """Several tables that change together: a commit puts rows of all of them in place by one manifest, or of none.

    Appended tables keep what they had, replaced ones do not. A commit may carry the number of a stream's batch: a batch that comes again, after a failure
    between its commit and the stream's own record of it, changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, source: str):
        super().__init__(spark, folder, source, "", "")

    def put(self, appended: dict[str, DataFrame], replaced: dict[str, DataFrame], batch: int | None = None) -> int:
        """Commits a new version and returns its number; the number of the present one, if the batch is in it already."""
        before = self.manifest() or {"version": 0, "batch": -1, "tables": {}}
        if batch is not None and batch <= before["batch"]:
            return before["version"]
        tables = dict(before["tables"])
        for name, rows in (appended | replaced).items():
            data = f"data/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.folder}/{data}")
            files = [f"{data}/{f.getPath().getName()}" for f in self._system().listStatus(self._path(data)) if f.getPath().getName().startswith("part-")]
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            old = tables[name]["files"] if name in appended and name in tables else []
            tables[name] = {"files": [*old, *sorted(files)], "schema": schema}
        number = before["version"] + 1
        self._put({"format": FORMAT, "source": self.source, "version": number, "batch": before["batch"] if batch is None else batch, "tables": tables})
        return number

    def table(self, name: str) -> DataFrame | None:
        """The rows of a table in the last version; None before it is first written."""
        found = (self.manifest() or {"tables": {}})["tables"].get(name)
        return found and self.spark.read.schema(found["schema"]).parquet(*(f"{self.folder}/{f}" for f in found["files"]))
