"""Keyed state with timers over Structured Streaming: priorities, strikes and commitments of windows, with block heights as event time.

A block height is an event time of BLOCK_SECONDS a block, and a watermark over heights says up to which block events are final. State lives in Spark's own
store, keyed: a micro-batch touches the keys that it has events or due timers of and no others, and a batch that runs again after a failure starts from the
state before it. What depends on order waits in the state until the watermark has passed it and is then taken in order of (block, key), so events may
come in any order within ``delay`` blocks; older ones than that are dropped by Spark.

The store has to be RocksDB's (``use_store``). Rows: events with a null key or block are dropped. A repeated event counts once. Event columns other than the
named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gradelake.config import PROTOCOL, Protocol
from gradelake.functions import native as N
from gradelake.streaming.audits import NO_STRIKE

BLOCK_SECONDS = 12
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def timed(events: DataFrame, block: str, delay: int) -> DataFrame:
    """events with their block as event time, final ``delay`` blocks behind the highest."""
    at = F.timestamp_seconds(F.col(block) * BLOCK_SECONDS)
    return events.withColumn("at_", at).withWatermark("at_", f"{delay * BLOCK_SECONDS} seconds")


def height(ms: int) -> int:
    return int(ms) // (1000 * BLOCK_SECONDS)


def moment(block: int) -> int:
    """Milliseconds of a block. A timer fires once the watermark is at this time; a watermark lies ``delay`` behind the highest block."""
    return int(block) * 1000 * BLOCK_SECONDS


class Priorities(StatefulProcessor):
    """The earliest (block, hotkey) of a key; a row for each change of the holder, with the one that it displaces."""

    def init(self, handle) -> None:
        self.holder = handle.getValueState("holder", "block long, hotkey string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        had = self.holder.get() if self.holder.exists() else None
        held = None if had is None else (had[0], had[1])
        best = min([(r.block, r.hotkey) for r in rows] + ([] if held is None else [held]))
        if best != held:
            self.holder.update(best)
            yield Row(key=key[0], block=best[0], hotkey=best[1], displaced=None if held is None else held[1])

    def close(self) -> None:
        pass


def priorities(events: DataFrame) -> DataFrame:
    """Updates (key, block, hotkey, displaced) of a stream of submissions (key, block, hotkey): the last update of a key is its holder, whatever the order of
    arrival; ``displaced`` tells whose result is to be retracted (null for a first holder)."""
    sound = events.where("key IS NOT NULL AND block IS NOT NULL AND hotkey IS NOT NULL").select("key", "block", "hotkey")
    return sound.groupBy("key").transformWithState(Priorities(), "key string, block long, hotkey string, displaced string", "update", "None")


class _Ordered(StatefulProcessor):
    """Events wait in the state; a timer at an event's block hands over all that are due, in order."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "block long, what string", "commit long")

    def wait(self, block: int, what: str, commit: int) -> None:
        if not self.waiting.containsKey((block, what)):
            self.waiting.updateValue((block, what), (commit,))
            self.handle.registerTimer(moment(block))

    def due(self, ms: int) -> list[tuple[int, str, int]]:
        ready = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator() if moment(k[0]) <= ms)
        for block, what, _ in ready:
            self.waiting.removeKey((block, what))
        return ready

    def close(self) -> None:
        pass


class Strikes(_Ordered):
    """Distinct failures of a hotkey; at the limit it is out for a number of blocks, in which failures do not count, and then begins anew."""

    def __init__(self, limit: int, duration: int) -> None:
        self.limit, self.duration = limit, duration

    def init(self, handle) -> None:
        super().init(handle)
        self.keys = handle.getMapState("keys", "key string", "block long")
        self.until = handle.getValueState("until", "block long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.wait(r.block, r.key, 0)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        final = timerValues.getCurrentWatermarkInMs()  # all that is due is taken at the first timer of a batch; the others find nothing
        for block, what, _ in self.due(final):
            yield from self.released(key, block)
            if self.until.exists():
                continue
            self.keys.updateValue((what,), (block,))
            count = sum(1 for _ in self.keys.keys())
            if count >= self.limit:
                self.keys.clear()
                self.until.update((block + self.duration,))
                self.handle.registerTimer(moment(block + self.duration))
                yield Row(hotkey=key[0], event="blacklisted", block=block, until_block=block + self.duration)
        yield from self.released(key, height(final))

    def released(self, key, block: int) -> Iterator[Row]:
        if self.until.exists() and self.until.get()[0] <= block:
            until = self.until.get()[0]
            self.until.clear()
            yield Row(hotkey=key[0], event="released", block=until, until_block=until)


def strikes(failures: DataFrame, delay: int, limit: int = 3, duration: int = 7_200) -> DataFrame:
    """Events (hotkey, event: blacklisted or released, block, until_block) of a stream of failures (hotkey, key, reason, block). Races of the lifecycle do not count."""
    sound = failures.where("hotkey IS NOT NULL AND key IS NOT NULL AND block IS NOT NULL").where(~F.coalesce("reason", F.lit("")).isin(*NO_STRIKE))
    events = timed(sound.select("hotkey", "key", F.col("block").cast("long").alias("block")), "block", delay)
    return events.groupBy("hotkey").transformWithState(Strikes(limit, duration), "hotkey string, event string, block long, until_block long", "append", "EventTime")


class Commitments(_Ordered):
    """A hotkey's commitment from window to window: at a window's first block the latest one that was committed and seen before it."""

    def __init__(self, blocks: int) -> None:
        self.blocks = blocks

    def init(self, handle) -> None:
        super().init(handle)
        self.now = handle.getValueState("now", "commit_block long, digest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            start = (max(r.commit_block, r.seen_block) // self.blocks + 1) * self.blocks
            self.wait(start, f"{r.commit_block:020d}\0{r.digest}", r.commit_block)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first: dict[int, tuple[int, str]] = {}
        for start, what, commit in self.due(expiredTimerInfo.getExpiryTimeInMs()):
            first[start] = max(first.get(start, (commit, "")), (commit, what.split("\0", 1)[1]))
        for start, best in sorted(first.items()):
            held = tuple(self.now.get()) if self.now.exists() else None
            if held is None or best > held:
                self.now.update(best)
                yield Row(hotkey=key[0], window=start // self.blocks, commit_block=best[0], digest=best[1], replaced=None if held is None else held[1])


def commitments(seen: DataFrame, delay: int, protocol: Protocol = PROTOCOL) -> DataFrame:
    """Changes (hotkey, window, commit_block, digest, replaced) of a stream of commitments (hotkey, digest, commit_block, seen_block: the finalised head at which it
    was read). A commitment takes part from the first window that begins after it was both committed and seen; one that is seen late goes to the
    next window, never into one that has begun. Of one block the larger digest counts."""
    sound = seen.where("hotkey IS NOT NULL AND digest IS NOT NULL AND commit_block >= 0 AND seen_block >= 0")
    events = timed(sound.select("hotkey", "digest", *[F.col(c).cast("long").alias(c) for c in ("commit_block", "seen_block")]), "seen_block", delay)
    kind = "hotkey string, window long, commit_block long, digest string, replaced string"
    return events.groupBy("hotkey").transformWithState(Commitments(protocol.window_blocks), kind, "append", "EventTime")


def commitments_batch(seen: DataFrame, head: int, protocol: Protocol = PROTOCOL) -> DataFrame:
    """hotkey, window, commit_block, digest: what ``commitments`` has told of all windows that began up to the block ``head``, from all events at once."""
    start = N.window_of(F.greatest("commit_block", "seen_block"), protocol) + 1
    every = seen.where("hotkey IS NOT NULL AND digest IS NOT NULL AND commit_block >= 0 AND seen_block >= 0").select("hotkey", start.alias("window"), F.struct("commit_block", "digest").alias("c"))
    best = every.where(F.col("window") * protocol.window_blocks <= head).groupBy("hotkey", "window").agg(F.max("c").alias("c"))
    before = best.alias("a").join(best.alias("b"), (F.col("a.hotkey") == F.col("b.hotkey")) & (F.col("b.window") < F.col("a.window")) & (F.col("b.c") >= F.col("a.c")), "left_anti")
    return before.select("a.hotkey", "a.window", "a.c.commit_block", "a.c.digest")


def run(changes: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Starts a stream of changes over all data that is there now; they are appended to Parquet files in ``folder``."""
    if mode == "append":
        return changes.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    # Updates: a batch writes its own folder, which a batch that runs again replaces.
    writer = changes.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/v={n}"))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def holders(folder: str, spark: SparkSession) -> DataFrame:
    """key, block, hotkey from the updates of ``priorities`` in a folder."""
    return spark.read.parquet(f"{folder}/v=*").groupBy("key").agg(F.max_by(F.struct("block", "hotkey"), "batch").alias("x")).select("key", "x.block", "x.hotkey")
