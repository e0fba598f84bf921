"""Progress and health of a loop: rows, seconds and failures of its stages in a table, from metrics that Spark collects while the stages run.

Rows are counted by ``DataFrame.observe`` in the pass that the stage makes anyway. Each stage appends one row when it ends, well or not, so the table is also
the heartbeat: its newest row tells when the loop was last alive. Streams report through a listener, a row a micro-batch.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "run string, stage string, ended timestamp, seconds double, rows map<string,long>, status string, error string"


class Health:
    """The metrics table of a folder, written under one run's name."""

    def __init__(self, spark: SparkSession, folder: str, run: str | None = None) -> None:
        self.spark, self.folder, self.run = spark, folder, run or uuid.uuid4().hex
        self._watched: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str) -> DataFrame:
        """df, whose rows count under ``name`` in the stage that reads it (once)."""
        self._watched[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return df.observe(self._watched[name], F.count(F.lit(1)).alias("rows"))

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Times what is done inside; a failure is written down and goes on upwards. Only tables that were read to their end have a count."""
        began, error = time.monotonic(), None
        self._watched = {}
        try:
            yield
        except Exception as e:
            error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            raise
        finally:
            counts = {} if error else {k: o.get["rows"] for k, o in self._watched.items()}
            self.tell(name, time.monotonic() - began, counts, error)

    def tell(self, stage: str, seconds: float, rows: dict[str, int], error: str | None = None) -> None:
        row = self.spark.createDataFrame([(self.run, stage, float(seconds), rows, "ok" if error is None else "failed", error)], "run string, stage string, seconds double, rows map<string,long>, status string, error string")
        row.withColumn("ended", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.folder)

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.folder)

    def summary(self) -> DataFrame:
        """stage, runs, failures, seconds and last (heartbeat) of every stage."""
        return self.table().groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failures"), F.sum("seconds").alias("seconds"), F.max("ended").alias("last"))

    def alive(self, seconds: float) -> bool:
        """Whether any stage ended within the last ``seconds``."""
        return bool(self.table().agg(F.coalesce(F.max("ended") >= F.current_timestamp() - F.expr(f"INTERVAL {float(seconds)} SECOND"), F.lit(False))).first()[0])


class StreamHealth(StreamingQueryListener):
    """Micro-batches of all streams of a session as stages of a health table; add it with ``spark.streams.addListener``."""

    def __init__(self, health: Health) -> None:
        self.health = health

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.health.tell(f"stream {p.name or p.id}", p.batchDuration / 1000, {"input": p.numInputRows, **{f"state {i}": s.numRowsTotal for i, s in enumerate(p.stateOperators)}})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.health.tell(f"stream {event.id}", 0.0, {}, str(event.exception).splitlines()[0])
