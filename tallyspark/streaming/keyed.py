"""Keyed streams with event-time timers: alerts that look back, and processes that fall silent.

A key's events wait until the watermark has passed them and are then taken in
the order of their time, each once, however late (within the watermark), out of
order or often they arrive. What a key remembers is bounded: the last few times
of an alert, the state of a process. State and timers are part of the query's
checkpoint, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tallyspark.operators.ops import ALERT_RULES, RETENTION_FAILURE, RETENTION_MINUTES
from tallyspark.sources.storage import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside it keep their state in the store that keyed timers need; the session's setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


#: How many buckets keys are dealt to. A fixed value: what a checkpoint holds lies by bucket.
BUCKETS = 4_096
#: What waits of an event, before its key.
EVENT = {"ms": "long", "event_id": "long", "what": "string"}


class InOrder(StatefulProcessor):
    """Events (ms, event_id, what) of keys, in order, once the watermark is past them.

    Python's calls for state and timers cost far more than an event. So what
    Spark keeps state by is a bucket of keys: their events wait together, lists
    of columns for each batch, and so does what is remembered of them. The calls
    then grow with the buckets, not with the keys.

    A subclass has MEMORY (fields of what a key remembers), TOLD (fields of its
    rows, after the key's), start() (of a new key), step(key, memory, ms, what)
    and silent(key, memory, before), which yield rows (nothing else is to come
    before that moment), and due(key, memory), the moment past which silent()
    wants to hear of the time, or None where nothing is left to remember.
    """

    MEMORY: dict[str, str] = {}
    TOLD: dict[str, str] = {}

    def __init__(self, key: dict[str, str]):
        self.key = key

    def init(self, handle) -> None:
        columns = lambda kinds: ", ".join(f"{name} array<{kind}>" for name, kind in kinds.items())
        self.handle = handle
        self.waiting = handle.getListState("waiting", columns(EVENT | self.key))
        self.memory = handle.getValueState("memory", columns(self.key | self.MEMORY))
        self.heard = set()

    def handleInputRows(self, key, rows, timerValues):
        passed, first = timerValues.getCurrentWatermarkInMs(), None
        for df in rows:
            fresh = df[df["ms"] > passed]
            if len(fresh):
                self.waiting.appendValue(tuple(fresh[c].tolist() for c in EVENT | self.key))
                least = int(fresh["ms"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if key in self.heard:  # by an earlier timer of this batch
            return
        self.heard.add(key)
        passed, wide = timerValues.getCurrentWatermarkInMs(), len(self.key)
        memories = {r[:wide]: list(r[wide:]) for r in zip(*(self.memory.get() or ()))}
        told, later = [], []
        for r in sorted({r for batch in self.waiting.get() for r in zip(*batch)}):
            if r[0] > passed:
                later.append(r)
                continue
            of = r[3:]
            if of not in memories:
                memories[of] = self.start()
            told += [of + x for x in self.step(of, memories[of], r[0], r[2])]
        # No event up to the watermark can come any more.
        for of, memory in memories.items():
            told += [of + x for x in self.silent(of, memory, passed + 1)]
        due = {of: self.due(of, memory) for of, memory in memories.items()}
        kept = [(*of, *memories[of]) for of, at in due.items() if at is not None]
        if later:
            self.waiting.put([tuple(map(list, zip(*later)))])
        else:
            self.waiting.clear()
        if kept:
            self.memory.update(tuple(map(list, zip(*kept))))
        else:
            self.memory.clear()
        times = [r[0] for r in later[:1]] + [at for at in due.values() if at is not None]
        if times:
            self.handle.registerTimer(min(times))
        if told:
            yield pd.DataFrame(told, columns=[*self.key, *self.TOLD])

    def close(self) -> None:
        pass


def _in_buckets(rows: DataFrame, processor: InOrder) -> DataFrame:
    """What the processor tells of rows (EVENT and its key, with a watermark)."""
    fields = ", ".join(f"{name} {kind}" for name, kind in (processor.key | processor.TOLD).items())
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*processor.key), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=fields, outputMode="Append", timeMode="EventTime")


class LookBack(InOrder):
    """Raises an alert when a key has so many events within so many minutes, and lets it lapse."""

    MEMORY = {"since": "long", "n": "long", "last": "array<long>"}
    TOLD = {"change": "string", "ms": "long", "n": "long"}

    def __init__(self, rules: dict[str, tuple[int, int]]):
        super().__init__({"event_type": "string", "actor": "string"})
        self.rules = rules

    def start(self):
        return [None, 0, []]

    def _span(self, key) -> int:
        return self.rules[key[0]][0] * 60_000

    def _lapse(self, key, memory, before: int):
        if memory[0] is not None and memory[2][0] + self._span(key) < before:
            memory[0] = None
            yield "LAPSED", memory[2][0] + self._span(key), memory[1]

    def step(self, key, memory, ms, what):
        yield from self._lapse(key, memory, ms)
        least = self.rules[key[0]][1]
        memory[2] = [*memory[2], ms][-least:]
        if len(memory[2]) == least and ms - memory[2][0] <= self._span(key):
            memory[1] = memory[1] + 1 if memory[0] is not None else least
            if memory[0] is None:
                memory[0] = ms
                yield "RAISED", ms, least

    def silent(self, key, memory, before):
        yield from self._lapse(key, memory, before)
        if memory[0] is None and memory[2] and memory[2][-1] + self._span(key) < before:
            memory[2] = []

    def due(self, key, memory):
        return memory[2][-1 if memory[0] is None else 0] + self._span(key) if memory[2] else None


EVERY_RULE = ALERT_RULES | {RETENTION_FAILURE: (RETENTION_MINUTES, 1)}


def _of_rules(log: DataFrame, rules: dict) -> DataFrame:
    """The events that rules speak of: event_type, actor (failed retention has one of its own), event_id, created_at, ms."""
    who = F.when(F.col("event_type") == RETENTION_FAILURE, "retention").otherwise(F.coalesce(F.col("actor_id").cast("string"), F.col("entity_id").cast("string"), F.lit("unknown")))
    kept = log.where(F.col("event_type").isin(*rules) & F.col("created_at").isNotNull())
    return kept.select("event_type", who.alias("actor"), F.coalesce(F.col("event_id").cast("long"), F.lit(-1)).alias("event_id"), F.col("created_at").cast("timestamp").alias("created_at"), F.unix_millis(F.col("created_at").cast("timestamp")).alias("ms"))


def lookback_alerts(log: DataFrame, rules: dict[str, tuple[int, int]] | None = None, late: str = "2 hours") -> DataFrame:
    """(event_type, actor, change, ms, n) from a stream of (event_id, event_type, actor_id, entity_id, created_at): RAISED when an actor has a rule's number of events within its minutes, LAPSED at the last moment this holds, with the events of the whole alert.

    Every span slides with each event and ends by itself, without an event. An
    alert stands at a moment between the two; moments are in milliseconds since
    1970. Events later than `late` behind the newest one are left out. Start the
    query inside keyed_state().
    """
    rules = rules or EVERY_RULE
    ship(log.sparkSession)
    rows = _of_rules(log, rules).withWatermark("created_at", late).withColumn("what", F.lit(""))
    return _in_buckets(rows, LookBack(rules))


def lookback_changes(log: DataFrame, rules: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """lookback_alerts() of a table, by windows: of n events in a row the first opens as many minutes in which the last one raises or prolongs an alert."""
    rules = rules or EVERY_RULE
    rows = _of_rules(log, rules).drop("created_at").distinct()
    of_key = Window.partitionBy("event_type", "actor").orderBy("ms", "event_id")
    of_kind = lambda f: F.coalesce(*[F.when(F.col("event_type") == k, f(k)) for k in rules])
    end = of_kind(lambda k: F.lag("ms", rules[k][1] - 1).over(of_key) + rules[k][0] * 60_000)
    held = rows.withColumn("end", end).where(F.col("ms") <= F.col("end"))
    fresh = F.coalesce(F.col("ms") > F.lag("end").over(of_key), F.lit(True))
    each = held.withColumn("alert", F.sum(fresh.cast("int")).over(of_key)).groupBy("event_type", "actor", "alert").agg(F.min("ms").alias("since"), F.max("end").alias("end"), F.count("*").alias("m"))
    least = of_kind(lambda k: F.lit(rules[k][1]).cast("long"))
    both = F.array(F.struct(F.lit("RAISED").alias("change"), F.col("since").alias("ms"), least.alias("n")), F.struct(F.lit("LAPSED").alias("change"), F.col("end").alias("ms"), (least + F.col("m") - 1).alias("n")))
    return each.select("event_type", "actor", F.explode(both).alias("c")).select("event_type", "actor", "c.*")


def standing(changes: DataFrame) -> DataFrame:
    """(event_type, actor, since) of the alerts that no later change has ended."""
    last = changes.groupBy("event_type", "actor").agg(F.max_by(F.struct("change", "ms"), F.struct("ms", F.col("change") == "LAPSED")).alias("c"))
    return last.where("c.change = 'RAISED'").select("event_type", "actor", F.col("c.ms").alias("since"))


#: The states of a process and what may follow each; "" is no process yet.
FOLLOWS = {"": ("PENDING",), "PENDING": ("EXTRACTING", "FAILED"), "EXTRACTING": ("COMPARING", "DONE", "FAILED"), "COMPARING": ("DONE", "FAILED")}
#: A silent process may start over from these; seconds of silence.
RESTARTS, STALE_SECONDS = ("EXTRACTING", "COMPARING"), 45
HEARTBEAT = "HEARTBEAT"


class Watch(InOrder):
    """Follows a process through its states and tells when it falls silent."""

    MEMORY = {"status": "string", "last": "long", "stale": "boolean"}
    TOLD = {"change": "string", "before": "string", "after": "string", "ms": "long"}

    def __init__(self, kind: str, seconds: int, remember_hours: int):
        super().__init__({"process_id": kind})
        self.silence, self.remember = seconds * 1000, remember_hours * 3_600_000

    def start(self):
        return ["", None, False]

    def silent(self, key, memory, before):
        status, last, stale = memory
        if status in FOLLOWS and last is not None and not stale and last + self.silence < before:
            memory[2] = True
            yield "STALE", status, status, last + self.silence
        if last is not None and last + self.remember < before:
            memory[:] = self.start()

    def step(self, key, memory, ms, what):
        yield from self.silent(key, memory, ms)
        status, _, stale = memory
        beat = what == HEARTBEAT and status in FOLLOWS and status != ""
        if not (beat or what in FOLLOWS.get(status, ()) or stale and status in RESTARTS and what == RESTARTS[0]):
            yield "REFUSED", status, what, ms
            return
        after = status if beat else what
        if stale or not beat:
            yield "RESUMED" if stale else "STEP", status, after, ms
        memory[:] = [after, ms, False]

    def due(self, key, memory):
        status, last, stale = memory
        if last is None:
            return None
        return last + (self.remember if stale or status not in FOLLOWS else min(self.silence, self.remember))


def watched(events: DataFrame, seconds: int = STALE_SECONDS, late: str = "1 minute", remember_hours: int = 24) -> DataFrame:
    """(process_id, change, before, after, ms) from a stream of (process_id, event_id, status, at): STEP to the next state, REFUSED where a state may not follow, STALE when nothing was heard for so many seconds, RESUMED at the first sign after that.

    status is a state or HEARTBEAT, which only shows that a process goes on. A
    stale process may start its reading over. Refused events are no sign of
    life. A process is forgotten so many hours after its last sign. Start the
    query inside keyed_state().
    """
    ship(events.sparkSession)
    rows = events.where("process_id is not null and status is not null and at is not null").select(
        "process_id", F.coalesce(F.col("event_id").cast("long"), F.lit(-1)).alias("event_id"), F.col("at").cast("timestamp").alias("at"), F.unix_millis(F.col("at").cast("timestamp")).alias("ms"), F.col("status").alias("what")
    ).withWatermark("at", late)
    kind = rows.schema["process_id"].dataType.simpleString()
    return _in_buckets(rows, Watch(kind, seconds, remember_hours))


def run(stream: DataFrame, folder: str) -> DataFrame:
    """Runs an appending stream until its source is read; folder holds its table and its checkpoint, and a second call goes on from there."""
    spark = stream.sparkSession
    with keyed_state(spark):
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").format("parquet").option("path", f"{folder}/table").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")
