"""Published versions of a set of tables, with undo and redo, in a shared folder."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Versions that can be undone (a fixed value of the editor), and the greatest size of a version that is loaded.
UNDONE, MOST_BYTES = 64, 10**15


class Versions:
    """Versions in ``folder``, which all executors share.

    A version is a folder of tables that is complete before anything names it: tables are
    written to a staging folder, which is renamed, and then a small file with the
    current version and those to undo and redo is put in place of the old one, in one
    rename. A writer that dies earlier leaves the old state as it was, and folders that
    ``recover`` deletes. One writer at a time is asked for.
    """

    def __init__(self, spark: SparkSession, folder: str, undone: int = UNDONE):
        self._spark, self._undone = spark, undone
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._root = self._path(folder)
        self._files = self._root.getFileSystem(self._conf)
        self._files.mkdirs(self._root)

    def _path(self, *parts: str):
        path = self._jvm.org.apache.hadoop.fs.Path(parts[0])
        for part in parts[1:]:
            path = self._jvm.org.apache.hadoop.fs.Path(path, part)
        return path

    def _in(self, *parts: str):
        return self._path(self._root.toString(), *parts)

    def _rename(self, source, target) -> None:
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), self._conf).rename(source, target, how)

    def state(self) -> dict:
        """``current`` (a version or null), ``undo`` and ``redo`` (versions, the latest last), ``last`` (the number of the latest)."""
        path = self._in("state.json")
        if not self._files.exists(path):
            return {"current": None, "undo": [], "redo": [], "last": 0}
        stream = self._files.open(path)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _point(self, state: dict) -> None:
        path = self._in(f"state-{uuid.uuid4().hex}.tmp")
        stream = self._files.create(path, True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
            stream.hsync()
        finally:
            stream.close()
        self._rename(path, self._in("state.json"))

    def publish(self, tables: dict[str, DataFrame]) -> str:
        """Makes ``tables`` the current version and returns its name; the one before can be undone, what was undone is gone.

        At most ``undone`` versions stay to be undone, the oldest are deleted first.
        Tables may read the current version, as nothing of it is overwritten.
        """
        state = self.state()
        staging = self._in(f"staging-{uuid.uuid4().hex}")
        for name, rows in tables.items():
            rows.write.parquet(self._path(staging.toString(), name).toString())
        version = f"v{state['last'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        self._rename(staging, self._in(version))
        undo = [v for v in (*state["undo"], state["current"]) if v]
        self._point({"current": version, "undo": undo[max(0, len(undo) - self._undone) :], "redo": [], "last": state["last"] + 1})
        self.recover()
        return version

    def _step(self, back: str, forth: str) -> str | None:
        state = self.state()
        if not state[back]:
            return None
        state[forth].append(state["current"])
        state["current"] = state[back].pop()
        self._point(state)
        return state["current"]

    def undo(self) -> str | None:
        """Goes back to the version before, if there is one."""
        return self._step("undo", "redo")

    def redo(self) -> str | None:
        """Goes forth to the version that was undone last, if there is one."""
        return self._step("redo", "undo")

    def load(self, table: str, version: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
        """A table of the current version, or of another that can still be undone or redone; one that is too large is refused."""
        state = self.state()
        version = version or state["current"]
        if version is None or version not in (state["current"], *state["undo"], *state["redo"]):
            raise ValueError(f"there is no version {version}")
        path = self._in(version, table)
        if not self._files.exists(path):
            raise ValueError(f"version {version} has no table {table}")
        size = self._files.getContentSummary(path).getLength()
        if size > most_bytes:
            raise ValueError(f"table {table} has {size} bytes, more than {most_bytes}")
        return self._spark.read.parquet(path.toString())

    def recover(self) -> int:
        """Deletes what no state names: staging folders, unnamed states, and versions that are neither current nor to undo or redo."""
        state = self.state()
        named = {"state.json", state["current"], *state["undo"], *state["redo"]}
        gone = [f.getPath() for f in self._files.listStatus(self._root) if f.getPath().getName() not in named and not f.getPath().getName().startswith(".")]
        for path in gone:
            self._files.delete(path, True)
        return len(gone)
