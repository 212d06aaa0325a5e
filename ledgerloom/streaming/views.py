"""Views kept fresh by a stream of events: each micro-batch recomputes only the projects it touches.

Order is by sequence, not by time, so there is no watermark: an event that is
not the next one of its project waits in a table of parked events, and nothing
expires.  Projects are dealt to PARTS by a hash; a batch writes anew the parts
of the view that it touches, and a line with the newest folder of each part.
That line is written last, under the number of its batch, and nothing is
overwritten that a reader may read, so a crash leaves the version before, and a
batch that runs again changes nothing.  Two events that claim one place are a
conflict, and stop the stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.events import EVENT, EventError
from ledgerloom.session import exists

PARTS = 16


def read_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Events as they are appended below a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


VIEW = "project_id string, n_events long, last_sequence long, active_session_id string, n_sessions long"


class ProjectView:
    """(project_id, n_events, last_sequence, active_session_id, n_sessions), kept by foreachBatch."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS) -> None:
        self.spark, self.root, self.parts = spark, root, parts

    def _newest(self) -> dict:
        """The line of the newest batch: its number, and the batch that last wrote each part of the view and of the parked events."""
        if not exists(self.spark, f"{self.root}/lines"):
            return {"batch": -1, "view": {}, "parked": {}}
        lines = self.spark.read.schema("batch long, line string").parquet(f"{self.root}/lines")
        return json.loads(lines.orderBy(F.col("batch").desc()).first()["line"])

    def _read(self, what: str, schema, of_part: dict[str, int], parts: set[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{what}/batch={batch}/part={part}" for part, batch in of_part.items() if parts is None or int(part) in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def parked(self) -> DataFrame:
        return self._read("parked", EVENT, self._newest()["parked"])

    def view(self) -> DataFrame:
        return self._read("view", VIEW, self._newest()["view"])

    def _write(self, df: DataFrame, what: str, batch_id: int) -> list[str]:
        """Write the parts of df, in the folder of the batch, which only this batch writes; the parts that have rows."""
        dealt = df.withColumn("part", F.pmod(F.xxhash64("project_id"), F.lit(self.parts)))
        dealt.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/{what}/batch={batch_id}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{what}/batch={batch_id}")
        statuses = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
        return [s.getPath().getName().removeprefix("part=") for s in statuses if s.getPath().getName().startswith("part=")]

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        now = self._newest()
        if batch_id <= now["batch"]:
            return  # done before
        names = [f.name for f in EVENT.fields]
        batch = batch.select(*names).persist()
        try:
            part = F.pmod(F.xxhash64("project_id"), F.lit(self.parts)).cast("int")
            touched = {r["p"] for r in batch.select(part.alias("p")).distinct().collect()}  # PARTS at most
            waiting = batch.unionByName(self._read("parked", EVENT, now["parked"], touched))
            if waiting.groupBy("project_id", "sequence").agg(F.min("id").alias("low"), F.max("id").alias("top")).where("low <> top").count():
                raise EventError("two events claim one place")
            waiting = waiting.dropDuplicates(["project_id", "sequence"])
            old = self._read("view", VIEW, now["view"], touched)
            last = old.select("project_id", F.col("last_sequence").alias("have"))
            place = F.row_number().over(Window.partitionBy("project_id").orderBy("sequence"))
            ready = waiting.join(last, "project_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("sequence") > F.col("have")).withColumn("place", place)
            in_place = F.col("sequence") == F.col("have") + F.col("place")
            new = summarize(ready.where(in_place))
            joined = old.alias("o").join(new.alias("n"), "project_id", "full_outer")
            merged = joined.select(
                "project_id",
                (F.coalesce("o.n_events", F.lit(0)) + F.coalesce("n.n_events", F.lit(0))).alias("n_events"),
                F.coalesce("n.last_sequence", "o.last_sequence").alias("last_sequence"),
                F.coalesce("n.active_session_id", "o.active_session_id").alias("active_session_id"),
                (F.coalesce("o.n_sessions", F.lit(0)) + F.coalesce("n.n_sessions", F.lit(0))).alias("n_sessions"),
            )
            written = {what: self._write(df, what, batch_id) for what, df in (("view", merged), ("parked", ready.where(~in_place).select(*names)))}
        finally:
            batch.unpersist()
        line = {"batch": batch_id, "view": now["view"] | dict.fromkeys(written["view"], batch_id), "parked": {p: b for p, b in now["parked"].items() if int(p) not in touched} | dict.fromkeys(written["parked"], batch_id)}
        self.spark.createDataFrame([(batch_id, json.dumps(line))], "batch long, line string").coalesce(1).write.mode("append").parquet(f"{self.root}/lines")


def summarize(events: DataFrame) -> DataFrame:
    """The view from scratch; the stream's view equals it for every prefix."""
    starts = F.col("event_type").isin("session.started", "session.resumed")
    return events.groupBy("project_id").agg(
        F.count("*").alias("n_events"), F.max("sequence").alias("last_sequence"), F.max_by(F.when(starts, F.col("session_id")), F.when(starts, F.col("sequence"))).alias("active_session_id"), F.count_if(starts).alias("n_sessions")
    )


def follow(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a view over what is there, batch by batch."""
    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
