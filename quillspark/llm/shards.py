"""Sharding by size-tiered compaction: arrivals become small immutable runs, runs of like size are merged into files of a target size, and each change is one new manifest.

The rows move in DataFrame reads and writes only. A manifest is a small JSON file that names the live files; it is
written aside and renamed to its final name, after an exclusive create has claimed its number: always the one after the version that
the change is based on. So a reader sees a version whole or not at all, of two writers of one version the second fails, and a job that
is lost midway leaves files that no manifest names. A job lost between claim and rename leaves a claim that makes every later change
fail, until recover() gives the claimed number to a copy of the version before.
"""

from __future__ import annotations

import contextlib
import json
import math
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import scratch, table


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Run:
    name: str
    files: tuple[str, ...]
    bytes: int


class ShardStore:
    """A table of immutable Parquet shards under root.

    target_bytes: size of the files that merges aim at. fanout: so many runs of a tier are merged; tier t holds the runs
    of fanout**t times the smallest size. An append of an empty table commits a version without a new file. Repeated rows,
    nulls, long texts and any column names are kept as they are; all appends must have the columns of the first.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4, base_bytes: int = 1 << 20):
        self.spark, self.root, self.target, self.fanout, self.base = spark, root.rstrip("/"), target_bytes, fanout, base_bytes
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    # -- manifests

    def _numbers(self, suffix: str) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[1 : -len(suffix)]) for n in names if n.startswith("v") and n.endswith(suffix))

    def versions(self) -> list[int]:
        return self._numbers(".json")

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "runs": []}
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version or known[-1]:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, base: dict, schema: str | None, runs: list[Run]) -> int:
        """Writes the next manifest, if base is still the latest."""
        latest = (self.versions() or [0])[-1]
        if latest != base["version"]:
            raise Conflict(f"version {latest} came after {base['version']}")
        version = latest + 1
        # Whoever holds a claim has its manifest aside, where recover() finds it.
        aside = self._aside(version, schema, runs)
        if not self._fs.createNewFile(self._path(f"{self.root}/manifest/v{version:08d}.claim")):
            self._fs.delete(aside, False)
            raise Conflict(f"version {version} is taken")
        self._name(aside, version)
        return version

    def _aside(self, version: int, schema: str | None, runs: list[Run]):
        aside = self._path(f"{self.root}/manifest/.v{version:08d}-{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "runs": [r.__dict__ for r in runs]}).encode()))
        out.close()
        return aside

    def _name(self, aside, version: int) -> None:
        try:
            named = self._fs.rename(aside, self._path(f"{self.root}/manifest/v{version:08d}.json"))
        except Py4JJavaError as e:  # what was aside is gone
            raise Conflict(f"version {version} was recovered") from e
        if not named:
            raise Conflict(f"version {version} could not be named")

    def recover(self) -> int:
        """Ends the claim on the next version, if there is one: its writer fails, if it still lives. Returns the latest version.

        Every manifest aside for that version is moved away first, so that no writer can name it any more; a writer that was faster has
        committed. The claim stays, and the version becomes a copy of the one before.
        """
        base = self.manifest()
        version = base["version"] + 1
        if version not in self._numbers(".claim"):
            return base["version"]
        for s in self._fs.listStatus(self._path(f"{self.root}/manifest")):
            if s.getPath().getName().startswith(f".v{version:08d}-"):
                with contextlib.suppress(Py4JJavaError):  # its writer was faster
                    self._fs.rename(s.getPath(), self._path(f"{self.root}/manifest/.dead-{uuid.uuid4().hex}"))
        if version not in self.versions():
            self._name(self._aside(version, base["schema"], [Run(r["name"], tuple(r["files"]), r["bytes"]) for r in base["runs"]]), version)
        return self.versions()[-1]

    # -- runs

    def _write(self, df: DataFrame) -> Run:
        name = f"run-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/data/{name}")
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(f"{self.root}/data/{name}")) if s.getPath().getName().endswith(".parquet")]
        return Run(name, tuple(f"{name}/{n}" for n, _ in sorted(found)), sum(size for _, size in found))

    def _read(self, schema: str, files: list[str]) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/data/{f}" for f in files]) if files else self.spark.createDataFrame([], kind)

    def append(self, df: DataFrame) -> int:
        """Adds the rows of df as one immutable run; returns the new version."""
        base = self.manifest()
        runs = [Run(r["name"], tuple(r["files"]), r["bytes"]) for r in base["runs"]]
        run = self._write(df)
        return self._commit(base, base["schema"] or df.schema.json(), runs + [run] * bool(run.files))

    def tier(self, run: Run) -> int:
        return max(0, math.floor(math.log(max(run.bytes, 1) / self.base, self.fanout))) if run.bytes > self.base else 0

    def _like(self, runs: list[Run]) -> list[Run]:
        """The runs to merge next: of the lowest tier that holds fanout of them, or none."""
        tiers: dict[int, list[Run]] = {}
        for r in runs:
            if r.bytes / len(r.files) < self.target / 2:
                tiers.setdefault(self.tier(r), []).append(r)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), [])

    def compact(self) -> int:
        """Merges until no tier holds fanout runs; each merge is a version. Merging shuffles nothing."""
        base = self.manifest()
        while like := self._like(runs := [Run(r["name"], tuple(r["files"]), r["bytes"]) for r in base["runs"]]):
            n = max(1, math.ceil(sum(r.bytes for r in like) / self.target))
            merged = self._write(self._read(base["schema"], [f for r in like for f in r.files]).coalesce(n))
            self._commit(base, base["schema"], [r for r in runs if r not in like] + [merged])
            base = self.manifest()
        return base["version"]

    def vacuum(self, keep: int = 1, grace_seconds: float = 86_400) -> list[str]:
        """Deletes the runs that only versions before the last keep ones name; these versions are gone then. Returns the names of the runs.

        A run that no manifest names may be one that a writer is about to commit: it goes only when it is older than grace_seconds.
        """
        old, kept = self.versions()[: -max(keep, 1)], self.versions()[-max(keep, 1) :]
        live = {r["name"] for v in kept for r in self.manifest(v)["runs"]}
        named = {r["name"] for v in old for r in self.manifest(v)["runs"]}
        for v in old:  # first, so that no version is seen without its files
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:08d}.json"), False)
        data = self._path(f"{self.root}/data")
        found = {s.getPath().getName(): s.getModificationTime() / 1000 for s in self._fs.listStatus(data)} if self._fs.exists(data) else {}
        dead = sorted(n for n, at in found.items() if n not in live and (n in named or time.time() - at > grace_seconds))
        for name in dead:
            self._fs.delete(self._path(f"{self.root}/data/{name}"), True)
        return dead

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default; of a store without one, an empty table without columns."""
        m = self.manifest(version)
        if m["schema"] is None:
            return self.spark.createDataFrame([], StructType([]))
        return self._read(m["schema"], [f for r in m["runs"] for f in r["files"]])


def op4_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in eight parts, are compacted, and are read back from the last version. Every version stays readable."""
    store, docs = ShardStore(spark, scratch(spark, "shards"), target_bytes=64 << 20), table(spark, sf_dir, "documents")
    for k in range(8):
        store.append(docs.filter(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(8)) == k))
        store.compact()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
