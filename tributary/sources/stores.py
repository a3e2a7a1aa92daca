"""Where a view's state is: pieces of partial states, merged when read.

A batch only appends its own partial state, so a commit costs as much as the batch, not as the state. After
some pieces they are merged into one. `MemoryStore` keeps plans for short folds; `TableStore` keeps Parquet
folders and a manifest in any file system that Spark knows, and survives restarts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class BatchIds:
    """Ids of added batches, all of them: those of the form source#number as ranges of numbers for each source, others one by one."""

    def __init__(self, ranges: dict[str, list[list[int]]] | None = None, others: list[str] | None = None):
        self.ranges, self.others = {k: [list(r) for r in v] for k, v in (ranges or {}).items()}, list(others or [])

    def __contains__(self, batch_id: str) -> bool:
        source, mark, number = batch_id.rpartition("#")
        if mark and number.isdecimal():
            return any(a <= int(number) <= b for a, b in self.ranges.get(source, ()))
        return batch_id in self.others

    def plus(self, batch_id: str | None) -> BatchIds:
        out = BatchIds(self.ranges, self.others)
        if batch_id is None or batch_id in out:
            return out
        source, mark, number = batch_id.rpartition("#")
        if mark and number.isdecimal():
            joined: list[list[int]] = []
            for a, b in sorted([*out.ranges.get(source, []), [int(number)] * 2]):
                if joined and a == joined[-1][1] + 1:
                    joined[-1][1] = b
                else:
                    joined.append([a, b])
            out.ranges[source] = joined
        else:
            out.others.append(batch_id)
        return out


class MemoryStore:
    """Pieces as DataFrames. Nothing is written: reading computes them anew, so it suits queries over fixed inputs."""

    def __init__(self) -> None:
        self.pieces: list[DataFrame] = []
        self.done = BatchIds()

    def has(self, batch_id: str) -> bool:
        return batch_id in self.done

    def append(self, df: DataFrame, batch_id: str | None = None) -> None:
        self.pieces.append(df)
        self.done = self.done.plus(batch_id)

    def replace(self, df: DataFrame | None, batch_id: str | None = None) -> None:
        self.pieces = [] if df is None else [df]
        self.done = self.done.plus(batch_id)

    def snapshot(self, df: DataFrame) -> DataFrame:
        """A table that later changes of the store leave as it is."""
        return df

    def read(self) -> DataFrame | None:
        out = None
        for p in self.pieces:
            out = p if out is None else out.unionByName(p)
        return out

    def crowded(self) -> bool:
        return False

    def next_batch(self) -> int:
        return len(self.pieces)


class TableStore:
    """Pieces as Parquet folders under root; a numbered manifest names those that count.

    A commit writes its folder first and then the next manifest under a new name, so a reader sees the state
    before or after it, and a batch id is applied once even if a job is tried again. Pieces that a merge has
    replaced stay until the next merge, for those who still read them.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = 16):
        self.spark, self.root, self.most = spark, root.rstrip("/"), most
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.fs.mkdirs(self.path(self.root))
        self.load()

    def load(self) -> None:
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path(self.root))]
        numbers = sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))
        self.number = numbers[-1] if numbers else -1
        self.manifest = {"pieces": [], "ranges": {}, "batches": [], "count": 0, "replaced": [], "snapshots": []}
        if numbers:
            lines = self.spark.read.text(f"{self.root}/manifest-{self.number:08d}.json", wholetext=True).first()
            self.manifest |= json.loads(lines[0])

    def _commit(self, manifest: dict) -> None:
        number = self.number + 1
        temp = self.path(f"{self.root}/.{uuid.uuid4().hex}")
        out = self.fs.create(temp)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        to = self.path(f"{self.root}/manifest-{number:08d}.json")
        if self.fs.exists(to) or not self.fs.rename(temp, to):
            raise RuntimeError(f"another writer has committed to {self.root}")
        self.number, self.manifest = number, manifest
        old = self.path(f"{self.root}/manifest-{number - 2:08d}.json")
        if number >= 2 and self.fs.exists(old):
            self.fs.delete(old, False)

    def _ids(self) -> BatchIds:
        return BatchIds(self.manifest["ranges"], self.manifest["batches"])

    def has(self, batch_id: str) -> bool:
        return batch_id in self._ids()

    def _write(self, df: DataFrame) -> list:
        name = f"piece-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return [name, df.schema.json()]

    def _next(self, pieces: list, batch_id: str | None, **more) -> dict:
        ids = self._ids().plus(batch_id)
        return self.manifest | {"pieces": pieces, "ranges": ids.ranges, "batches": ids.others, "count": self.manifest["count"] + 1} | more

    def _remove(self, names: list[str]) -> None:
        for name in names:
            self.fs.delete(self.path(f"{self.root}/{name}"), True)

    def append(self, df: DataFrame, batch_id: str | None = None) -> None:
        self._commit(self._next([*self.manifest["pieces"], self._write(df)], batch_id))

    def replace(self, df: DataFrame | None, batch_id: str | None = None) -> None:
        gone = self.manifest["replaced"]
        old = [name for name, _ in self.manifest["pieces"]]
        self._commit(self._next([] if df is None else [self._write(df)], batch_id, replaced=old))
        self._remove(gone)

    def snapshot(self, df: DataFrame) -> DataFrame:
        """A table that later changes of the store leave as it is, until two more are made."""
        name, _ = self._write(df)
        kept = [*self.manifest["snapshots"], name]
        self._commit(self.manifest | {"snapshots": kept[-2:]})
        self._remove(kept[:-2])
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def read(self) -> DataFrame | None:
        pieces = self.manifest["pieces"]
        if not pieces:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(pieces[-1][1]))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}" for name, _ in pieces])

    def crowded(self) -> bool:
        return len(self.manifest["pieces"]) > self.most

    def next_batch(self) -> int:
        return self.manifest["count"]
