"""Tables that change together: immutable generations of files and one commit that makes them visible.

Every change writes its rows beside the old ones, into folders of a generation
of its own, and then publishes one small commit file that names the generations
each table consists of. Commits are numbered, and a commit is renamed into
place only where no file has its number, so a reader sees the state before or
after a change, a writer that was overtaken fails without effect, and what a
killed writer left behind belongs to no commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit came first; nothing was published."""


class Store:
    """The tables below ``where``, any path that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, where: str) -> None:
        self.spark, self.where = spark, where.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.where}/{name}" if name else self.where)

    def _numbers(self) -> list[int]:
        folder = self._path("_commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def current(self, version: int | None = None) -> dict:
        """The newest commit, or that of ``version``: its number, the generations of each table, facts, and the last batch of each source."""
        numbers = self._numbers()
        if not numbers:
            return {"version": 0, "tables": {}, "facts": {}, "batches": {}}
        return json.loads(self._text(f"_commits/{version or numbers[-1]:012d}.json"))

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> bool:
        """A file that is there as a whole or not at all; False where one of that name is there already."""
        fresh, final = self._path(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"), self._path(name)
        out = self._fs.create(fresh, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        rename = self._hadoop.Options.Rename
        mode = self.spark.sparkContext._gateway.new_array(rename, 1)
        mode[0] = rename.NONE
        try:
            self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(fresh, final, mode)
        except Exception:
            self._fs.delete(fresh, False)
            if not self._fs.exists(final):
                raise
            return False
        return True

    def read(self, table: str, state: dict | None = None) -> DataFrame | None:
        """The rows of ``table`` in all its generations, with the generation as ``gen``; None where there is none."""
        gens = (state or self.current())["tables"].get(table, [])
        if not gens:
            return None
        base = f"{self.where}/{table}"
        schema = StructType.fromJson(json.loads(self._text(f"{table}/_schema"))).add("gen", "string")
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/gen={g}" for g in gens])

    def write(self, table: str, gen: str, df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """Write the rows of one generation of ``table`` and read them back; no reader sees them before a commit names them."""
        out = df.write.mode("overwrite")
        path = f"{self.where}/{table}/gen={gen}"
        (out.partitionBy(*by) if by else out).parquet(path)
        if not self._fs.exists(self._path(f"{table}/_schema")):
            self._put(f"{table}/_schema", df.schema.json())
        return self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def generation() -> str:
        return f"g{uuid.uuid4().hex}"

    def commit(self, base: dict, add: dict[str, str], replace: dict[str, str] | None = None, facts: dict | None = None, batch: tuple[str, int] | None = None) -> dict:
        """Publish a state that follows ``base``: ``add`` appends a generation to a table, ``replace`` makes one its only one.

        Raises ``Conflict`` where the store has moved on from ``base``.
        """
        tables = {t: [*g, add[t]] if t in add else list(g) for t, g in base["tables"].items()}
        tables |= {t: [g] for t, g in add.items() if t not in tables} | {t: [g] for t, g in (replace or {}).items()}
        state = {
            "version": base["version"] + 1, "tables": tables, "facts": base["facts"] | (facts or {}),
            "batches": base["batches"] | ({batch[0]: batch[1]} if batch else {}),
        }
        if not self._put(f"_commits/{state['version']:012d}.json", json.dumps(state)):
            raise Conflict(f"version {state['version']} of {self.where} is taken")
        return state

    def seen(self, source: str, batch: int, state: dict | None = None) -> bool:
        """Whether a batch of a source is part of the state already, so that running it again must do nothing."""
        return (state or self.current())["batches"].get(source, -1) >= batch

    def vacuum(self) -> int:
        """Delete the generations that the newest commit does not name, and all commits but that one; returns how many folders went.

        Only safe while nothing reads an older state and no writer is at work.
        """
        state, gone = self.current(), 0
        live = {f"{t}/gen={g}" for t, gens in state["tables"].items() for g in gens}
        for t in self._fs.listStatus(self._path("")):
            name = t.getPath().getName()
            if name.startswith("_"):
                continue
            for g in self._fs.listStatus(t.getPath()):
                if g.isDirectory() and f"{name}/{g.getPath().getName()}" not in live:
                    gone += self._fs.delete(g.getPath(), True)
        for n in self._numbers()[:-1]:
            self._fs.delete(self._path(f"_commits/{n:012d}.json"), False)
        return gone
