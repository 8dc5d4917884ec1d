"""Tables whose rows can be added, changed and taken out without being rewritten.

A table is a set of data folders and a set of tombstone folders (deleted keys).  A commit file holds the
whole state of one version: each folder with the version that its rows count from.  A row is gone if its
key has a tombstone of a later version than its own; readers merge the two sets (an anti join, only if
there are tombstones) and see one version from start to end, whatever is written meanwhile.

Writers put their folder down first and then create the next commit file, which one of them can
only do; the others read the new state and put their change on top of it.  So an append during a
delete is kept, a job that dies leaves a folder that no version names, and a change is seen whole or not at
all.  Creating a file under a name that must be free is atomic in HDFS and local folders.

``compact`` rewrites the live rows into one folder that counts from the version it has read, so
what others commit meanwhile still holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConflictError(RuntimeError):
    """Another writer has replaced the rows that this change was worked out from."""


@dataclass
class State:
    version: int = 0
    #: Folder -> version that its rows count from.
    data: dict[str, int] = field(default_factory=dict)
    deleted: dict[str, int] = field(default_factory=dict)


class RowTable:
    """One table below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str | None = None, partitions: list[str] = ()):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.partitions = key, list(partitions)

    # ---------------------------------------------------------------- commits
    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        where = hadoop.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def state(self) -> State:
        """The newest version; version 0 of a table that does not exist."""
        fs, log = self._fs(f"{self.path}/_commits")
        if not fs.exists(log):
            return State()
        names = (status.getPath().getName() for status in fs.listStatus(log))
        newest = max((int(name[:-5]) for name in names if name.endswith(".json")), default=0)
        if not newest:
            return State()
        _, where = self._fs(f"{self.path}/_commits/{newest:012d}.json")
        stream = fs.open(where)
        try:
            held = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return State(newest, held["data"], held["deleted"])

    def _put(self, state: State) -> bool:
        """Creates the commit file of the state's version; False if that version exists."""
        fs, target = self._fs(f"{self.path}/_commits/{state.version:012d}.json")
        _, draft = self._fs(f"{self.path}/_commits/.{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps({"data": state.data, "deleted": state.deleted}).encode()))
        stream.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        only_if_free = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, target, only_if_free)
            return True
        except Exception as error:
            if not fs.exists(target):
                raise
            fs.delete(draft, False)
            if "FileAlreadyExists" not in str(error):
                raise
            return False

    def commit(self, change: Callable[[State], State]) -> State:
        """Puts a change on top of the newest state, again and again until no one else came first."""
        while True:
            now = self.state()
            new = change(State(now.version + 1, dict(now.data), dict(now.deleted)))
            if self._put(new):
                return new

    # ---------------------------------------------------------------- folders
    def _write(self, df: DataFrame) -> str:
        """A new folder of rows that no version names yet."""
        name = uuid.uuid4().hex
        # Rebalancing splits a partition that holds most rows into several files.
        out = df.hint("rebalance", *[F.col(k) for k in self.partitions]) if self.partitions else df
        writer = out.write.partitionBy(*self.partitions) if self.partitions else out.write
        writer.parquet(f"{self.path}/data/folder={name}")
        return name

    def _write_keys(self, keys: DataFrame) -> str:
        name = uuid.uuid4().hex
        keys.select(F.col(self.key).alias("key")).where("key is not null").distinct().write.parquet(f"{self.path}/deleted/folder={name}")
        return name

    def _folders(self, kind: str, names, schema: T.StructType) -> DataFrame:
        reader = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("folder", T.StringType())]))
        return reader.option("basePath", f"{self.path}/{kind}").parquet(*(f"{self.path}/{kind}/folder={n}" for n in names))

    @staticmethod
    def _since(versions: dict[str, int]):
        return F.element_at(F.create_map(*(F.lit(x) for pair in versions.items() for x in pair)), F.col("folder"))

    def read(self, state: State | None = None, folders: list[str] | None = None) -> DataFrame:
        """The live rows of a version (the newest one), or of some of its folders."""
        state = state or self.state()
        names = [n for n in state.data if folders is None or n in folders]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        rows = self._folders("data", names, self.schema)
        oldest = min(state.data[n] for n in names)
        later = {n: v for n, v in state.deleted.items() if v > oldest}
        if later:
            key_type = self.schema[self.key].dataType
            gone = self._folders("deleted", later, T.StructType([T.StructField("key", key_type)]))
            gone = gone.groupBy("key").agg(F.max(self._since(later)).alias("_gone"))
            rows = rows.withColumn("_since", self._since({n: state.data[n] for n in names}))
            rows = rows.join(gone, (F.col(self.key) == F.col("key")) & (F.col("_since") < F.col("_gone")), "left_anti")
        return rows.select(*self.schema.names)

    # ---------------------------------------------------------------- changes
    def append(self, df: DataFrame) -> State:
        name = self._write(df)

        def change(s: State) -> State:
            s.data[name] = s.version
            return s

        return self.commit(change)

    def append_new(self, make: Callable[[DataFrame], DataFrame]) -> int:
        """Rows that ``make`` works out from the known ones (by key unknown); returns how many.

        If others have added rows meanwhile, those that they brought are left out.
        """
        base = self.state()
        name = self._write(make(self.read(base)))
        while True:
            now = self.state()
            others = [n for n in now.data if n not in base.data]
            if others:
                mine = self._folders("data", [name], self.schema).select(*self.schema.names)
                known = self.read(now, others).select(self.key)
                if not mine.join(known, self.key, "left_semi").isEmpty():
                    name = self._write(mine.join(known, self.key, "left_anti").select(*self.schema.names))
            data = {**now.data, name: now.version + 1}
            if self._put(State(now.version + 1, data, now.deleted)):
                return self._folders("data", [name], self.schema).count()
            base = now

    def delete(self, keys: DataFrame) -> State:
        """Takes out the rows that have one of the keys (a column named as the table's key)."""
        name = self._write_keys(keys)

        def change(s: State) -> State:
            s.deleted[name] = s.version
            return s

        return self.commit(change)

    def update(self, rows: DataFrame) -> State:
        """Puts whole rows in the place of those with their keys; in one commit."""
        name = self._write(rows)
        gone = self._write_keys(self._folders("data", [name], self.schema))

        def change(s: State) -> State:
            s.data[name] = s.deleted[gone] = s.version
            return s

        return self.commit(change)

    def replace(self, df: DataFrame, base: State | None = None) -> State:
        """The rows of ``base`` (the newest state) give way to these; rows that came later stay."""
        base = base or self.state()
        name = self._write(df)

        def change(s: State) -> State:
            if not base.data.keys() <= s.data.keys():
                raise ConflictError(f"{self.path}: replaced by another writer since version {base.version}")
            s.data = {n: v for n, v in s.data.items() if n not in base.data} | {name: base.version}
            s.deleted = {n: v for n, v in s.deleted.items() if n not in base.deleted}
            return s

        return self.commit(change)

    def compact(self) -> State:
        """One folder of live rows instead of many folders and tombstones."""
        base = self.state()
        return self.replace(self.read(base), base) if base.data else base
