"""A table with versions: changed by key, readable at any moment, safe against half-made writes.

Rows lie in groups of files by the leading bits of their keys' hash.  A change reads and rewrites
only the groups that hold keys of the change, in new files; the others stay as they are.  A group
that would grow beyond ``group_rows`` is split by further bits when it is rewritten, so groups stay
of one size as the table grows.

Groups of more than ``FOLDER_BITS`` bits share a folder with those of the same leading bits, and rows
say which group they are of.  So a table of many small groups is written, listed and read as a few
hundred folders.  Rows of a group that has been rewritten stay beside those of the others in its old
folder, are passed over by readers, and go with the folder.

A version is a manifest, a small file that names the groups' files.  It is written last, and ends in
a line that says how many groups it names; readers take the newest manifest that is whole.  So a
change that fails half-way leaves the version before it as it was, and a reader never sees half of
one.  Two writers cannot make the same version: the second stops, and can try again.

A change may carry a number, such as that of a micro-batch.  A change whose number the table already
holds does nothing, so one that runs again counts once.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaflow.session import written

GROUP_ROWS = 1 << 20
# A change writes its groups into one folder for each of so many leading bits, so folders stay few.
FOLDER_BITS = 8
_PLACE = "_depth int, _prefix bigint"
_FOLDERS = f"{_PLACE}, _write string, _part string"
_ADDED = ("_depth", "_prefix", "_write", "_part")


class Conflict(RuntimeError):
    """Another writer has made the version first."""


@dataclass(frozen=True)
class Group:
    """Rows whose hash begins with ``prefix``, ``depth`` bits long; no path if there are none."""

    depth: int
    prefix: int
    rows: int = 0
    path: str | None = None


@dataclass(frozen=True)
class Version:
    number: int
    change: int
    schema: T.StructType | None
    groups: tuple[Group, ...]

    def lines(self) -> str:
        head = {"change": self.change, "schema": self.schema.jsonValue()}
        each = [[g.depth, g.prefix, g.rows, g.path] for g in self.groups]
        return "\n".join(map(json.dumps, [head, *each, {"groups": len(each)}]))

    @staticmethod
    def of(number: int, text: str) -> Version | None:
        """None if the manifest is not whole."""
        try:
            head, *each, end = [json.loads(line) for line in text.split("\n")]
            if end != {"groups": len(each)}:
                return None
            return Version(number, head["change"], T.StructType.fromJson(head["schema"]), tuple(Group(*g) for g in each))
        except (ValueError, KeyError, TypeError):
            return None


_FIRST = Version(0, -1, None, (Group(0, 0),))


def _prefix(value: Column, depth: Column) -> Column:
    """The leading bits of a hash as a number; shifting by all 64 bits would shift by none."""
    shifted = F.call_function("shiftrightunsigned", value, (64 - depth).cast("int"))
    return F.when(depth == 0, F.lit(0).cast("bigint")).otherwise(shifted)


class VersionedTable:
    """A table of one row a key below a folder."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], group_rows: int = GROUP_ROWS):
        self.spark, self.path, self.keys, self.group_rows = spark, path.rstrip("/"), keys, group_rows

    # -- manifests

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        system, folder = self._folder("versions")
        if not system.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in system.listStatus(folder) if s.getPath().getName().isdigit())

    def _load(self, number: int) -> Version | None:
        system, path = self._folder(f"versions/{number:012d}")
        stream = system.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version.of(number, text)

    def _store(self, version: Version) -> None:
        system, path = self._folder(f"versions/{version.number:012d}")
        try:
            stream = system.create(path, False)
        except Exception as error:
            if "exist" in str(error).lower():
                raise Conflict(f"version {version.number} of {self.path} is there already") from None
            raise
        try:
            stream.write(bytearray(version.lines().encode()))
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """Numbers of all whole versions."""
        return [n for n in self._numbers() if self._load(n)]

    def current(self) -> Version:
        """The newest whole version; one without rows if there is none."""
        for number in reversed(self._numbers()):
            if found := self._load(number):
                return found
        return _FIRST

    # -- reading

    def _rows(self, version: Version, groups: list[Group]) -> DataFrame:
        """Rows of some groups, with the group's place."""
        alive = [g for g in groups if g.path]
        paths = sorted({f"{self.path}/files/{g.path}" for g in alive})
        schema = T.StructType([*version.schema.fields, *T._parse_datatype_string(_FOLDERS).fields])
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/files").parquet(*paths)
        if all(g.depth <= FOLDER_BITS for g in alive):
            return rows
        # The list of groups is the manifest's, so it is in the driver's memory anyway.
        places = [(g.depth, g.prefix, g.path.split("/")[0].removeprefix("_write=")) for g in alive]
        return rows.join(F.broadcast(self.spark.createDataFrame(places, f"{_PLACE}, _write string")), ["_depth", "_prefix", "_write"], "leftsemi")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the newest version, or of the one with this number."""
        found = self.current() if version is None else self._load(version)
        if found is None or found.schema is None:
            raise ValueError(f"{self.path} has no such version")
        return self._rows(found, list(found.groups)).drop(*_ADDED)

    def read_keys(self, wanted: DataFrame) -> DataFrame:
        """The rows of the wanted keys, read from their groups alone."""
        version = self.current()
        touched = self._touched(version, wanted.select(*self.keys).distinct())
        rows = self._rows(version, list(touched)).drop(*_ADDED)
        return rows.join(wanted.select(*self.keys).distinct(), self.keys, "leftsemi")

    def _placed(self, rows: DataFrame, groups: list[tuple]) -> DataFrame:
        """Rows with ``_depth`` and ``_prefix`` of their group and ``_to``, its depth from now on.

        A row is looked up under its prefix of each depth that some group has; one of them exists.
        """
        depths = sorted({g[0] for g in groups})
        known = self.spark.createDataFrame(groups, f"{_PLACE}, _to int")
        value = F.xxhash64(*self.keys)
        every = F.array(*[F.struct(F.lit(d).alias("d"), _prefix(value, F.lit(d)).alias("p")) for d in depths])
        tried = rows.withColumn("_hash", value).withColumn("_at", F.explode(every))
        found = tried.select("*", F.col("_at.d").alias("_depth"), F.col("_at.p").alias("_prefix")).drop("_at")
        return found.join(F.broadcast(known), ["_depth", "_prefix"])

    def _touched(self, version: Version, rows: DataFrame) -> dict[Group, int]:
        """Groups that hold keys of the rows, and how many rows each."""
        placed = self._placed(rows, [(g.depth, g.prefix, g.depth) for g in version.groups])
        met = {(r["_depth"], r["_prefix"]): r["count"] for r in placed.groupBy("_depth", "_prefix").count().collect()}
        return {g: met[g.depth, g.prefix] for g in version.groups if (g.depth, g.prefix) in met}

    # -- changing

    def upsert(
        self,
        new: DataFrame,
        combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
        change: int | None = None,
    ) -> Version:
        """Merge rows by ``combine`` (old, new), by default replacing rows of equal keys.

        ``combine`` sees the groups that the new rows touch, and gives what these groups hold from
        now on, so it can also leave rows out.
        """
        version = self.current()
        if change is not None and change <= version.change:
            return version
        new = written(new, "change")
        combine = combine or (lambda old, rows: old.join(rows, self.keys, "leftanti").unionByName(rows))
        if version.schema is None:
            version = Version(version.number, version.change, new.schema, version.groups)
        touched = self._touched(version, new)
        old = self._rows(version, list(touched)).drop(*_ADDED)
        merged = combine(old, new).select(*version.schema.names)
        further = {
            g: g.depth + max(0, math.ceil(math.log2(max(1, g.rows + more) / self.group_rows))) for g, more in touched.items()
        }
        name = f"_write={uuid.uuid4()}"
        if touched:
            placed = self._placed(merged, [(g.depth, g.prefix, to) for g, to in further.items()])
            final = placed.select(
                *version.schema.names, F.col("_to").alias("_depth"), _prefix(F.col("_hash"), F.col("_to")).alias("_prefix")
            )
            # One task a folder, unless Spark splits a large one.
            bits = F.least("_depth", F.lit(FOLDER_BITS))
            lead = F.call_function("shiftrightunsigned", "_prefix", F.col("_depth") - bits)
            parted = final.withColumn("_part", F.concat(F.lit("d"), bits.cast("string"), F.lit("p"), lead.cast("string")))
            parted.hint("rebalance", "_part").sortWithinPartitions("_part", "_depth", "_prefix").write.partitionBy(
                "_part"
            ).parquet(f"{self.path}/files/{name}")
        groups = [g for g in version.groups if g not in touched] + self._made(name, version, further)
        number = max([version.number, *self._numbers()]) + 1
        made = Version(number, version.change if change is None else change, version.schema, tuple(groups))
        self._store(made)
        return made

    def _made(self, name: str, version: Version, further: dict[Group, int]) -> list[Group]:
        """What the touched groups have become; those without rows stay as places for keys."""
        if not further:
            return []
        schema = T.StructType([*version.schema.fields, *T._parse_datatype_string(_PLACE).fields])
        files = self.spark.read.schema(schema).parquet(f"{self.path}/files/{name}")
        rows = {(r["_depth"], r["_prefix"]): r["count"] for r in files.groupBy("_depth", "_prefix").count().collect()}
        made = []
        for group, depth in further.items():
            for k in range(1 << (depth - group.depth)):
                prefix = (group.prefix << (depth - group.depth)) + k
                n = rows.get((depth, prefix), 0)
                bits = min(depth, FOLDER_BITS)
                made.append(Group(depth, prefix, n, f"{name}/_part=d{bits}p{prefix >> (depth - bits)}" if n else None))
        return made

    def delete(self, gone: DataFrame, change: int | None = None) -> Version:
        """Remove the rows of keys."""
        if self.current().schema is None:
            return self.current()
        names = self.current().schema.names
        return self.upsert(
            gone.select(*self.keys).distinct(),
            lambda old, rows: old.join(rows, self.keys, "leftanti").select(*names),
            change,
        )

    def expire(self, keep: int = 2) -> int:
        """Remove all but the newest whole versions, and files that only they name; how many files' folders went."""
        whole = [v for v in map(self._load, self._numbers()) if v]
        old, kept = whole[:-keep], whole[-keep:]
        used = {g.path for v in kept for g in v.groups}
        system, _ = self._folder("versions")
        for version in old:
            system.delete(self._folder(f"versions/{version.number:012d}")[1], False)
        gone = {g.path for v in old for g in v.groups if g.path} - used
        for path in gone:
            system.delete(self._folder(f"files/{path}")[1], True)
        return len(gone)
