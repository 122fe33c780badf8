"""One stream to several sinks: each isolated from the failures of the others, each given every batch once it works again.

A batch is spooled once. A sink's marker for a batch says that the sink has it; markers are written after the sink returned, so a sink
may see a batch again with the same number after a crash and has to be idempotent by number, as ``table_sink`` is. A sink that
fails keeps its place: later batches wait in the spool, in order, and no other sink waits for it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

Sink = Callable[[DataFrame, int], None]


class Files:
    """Marker files and folders in a store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def touch(self, name: str) -> None:
        self.fs.create(self._path(name), True).close()

    def write(self, name: str, text: str) -> None:
        """Shows all of ``text`` under the name or nothing: written beside it, then renamed."""
        beside = self._path(name + ".new")
        out = self.fs.create(beside, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        self.fs.delete(self._path(name), False)
        if not self.fs.rename(beside, self._path(name)):
            raise OSError(f"could not rename {beside}")

    def names(self, name: str) -> list[str]:
        at = self._path(name)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def table_sink(path: str, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Sink:
    """Writes each batch to a folder of its number; a batch that comes again replaces itself."""
    return lambda rows, number: change(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")


def deliver(spark: SparkSession, path: str, sinks: Mapping[str, Sink]) -> dict[str, str]:
    """Gives each sink the spooled batches that it lacks, in order; the failures by sink. Batches that all have go.

    Markers and spooled batches of a sink that is no longer named do not hold batches back.
    """
    files, failed = Files(spark, path), {}
    waiting = sorted(int(n) for n in files.names("spool") if files.exists(f"spool/{n}/_SUCCESS"))
    for name, sink in sinks.items():
        for number in waiting:
            if files.exists(f"done/{name}/{number}"):
                continue
            try:
                sink(spark.read.parquet(f"{path}/spool/{number}"), number)
            except Exception as e:  # the other sinks go on; this one is given the batch again
                failed[name] = str(e).split("\n")[0]
                break
            files.touch(f"done/{name}/{number}")
    for number in waiting:
        if all(files.exists(f"done/{name}/{number}") for name in sinks):
            files.touch(f"gone/{number}")
            files.delete(f"spool/{number}")
    return failed


def fan_out(stream: DataFrame, sinks: Mapping[str, Sink], path: str, checkpoint: str, on_failure: Callable[[str, int, str], None] = lambda sink, number, what: None):
    """A writer of ``stream`` to all ``sinks``; ``deliver`` serves sinks that failed without waiting for new rows.

    ``on_failure`` (sink, batch, first line of the error) is told of each failure; the stream goes on.
    """

    def apply(batch: DataFrame, number: int) -> None:
        files = Files(batch.sparkSession, path)
        if not files.exists(f"gone/{number}") and not files.exists(f"spool/{number}/_SUCCESS"):
            batch.write.mode("overwrite").parquet(f"{path}/spool/{number}")
        for name, what in deliver(batch.sparkSession, path, sinks).items():
            on_failure(name, number, what)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
