"""Streaming jobs: ingest into units, triggers by counts and runs, event windows, drift, supersession and speakers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from chronoweave.operators.temporal import create_facts
from chronoweave.operators.text import units
from chronoweave.operators.vectors import Adwin


def read_folder(spark: SparkSession, folder: str, schema, files_a_trigger: int = 16) -> DataFrame:
    """Files of a folder as a stream, in the order they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def ingest_units(docs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Split arriving documents into units and append them as Parquet; every document is taken once."""
    found = units(docs, "doc_id", "text")
    return found.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """(start, event_type, n) of tumbling windows; events later than ``late`` behind the newest are dropped."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n")


class Ledger:
    """Counters of a stream, one folder of rows for each batch; a batch that comes again finds its own folder.

    The folder is shared, so a restart, on whatever machine, goes on from the last batch that was written.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _batches(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [x.getPath().getName() for x in files.listStatus(path)]
        done = [n for n in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("batch-")) for n in done if n.startswith("batch-"))

    def before(self, batch: int) -> tuple[DataFrame | None, bool]:
        """(rows of the last batch before this one, whether this one is done)."""
        held = self._batches()
        old = [b for b in held if b < batch]
        return (self.spark.read.parquet(f"{self.folder}/batch-{old[-1]}") if old else None), batch in held

    def write(self, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")

    def latest(self) -> DataFrame | None:
        held = self._batches()
        return self.spark.read.parquet(f"{self.folder}/batch-{held[-1]}") if held else None


def due_recomputes(facts: DataFrame, thresholds: dict[str, int], run: Callable[[str, int], None], ledger: str, checkpoint: str) -> StreamingQuery:
    """Call ``run(kind, count)`` when the facts since its last call reach a kind's threshold; counts start anew then.

    Counts are kept in the shared folder ``ledger``; if a batch is repeated after a failure, a call may be too.
    """

    def batch(rows: DataFrame, number: int) -> None:
        held = Ledger(rows.sparkSession, ledger)
        old, done = held.before(number)
        if done:
            return
        waiting = dict.fromkeys(thresholds, 0) | ({r["kind"]: r["waiting"] for r in old.collect()} if old is not None else {})  # a row a kind
        n = rows.count()
        for kind, limit in thresholds.items():
            waiting[kind] += n
            if waiting[kind] >= limit:
                run(kind, waiting[kind])
                waiting[kind] = 0
        held.write(number, rows.sparkSession.createDataFrame(list(waiting.items()), "kind string, waiting long"))

    return facts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def every_n_runs(rows: DataFrame, periods: dict[str, int], run: Callable[[str, int], None], ledger: str, checkpoint: str, cooldown: float = 300.0) -> StreamingQuery:
    """Call ``run(kind, run number)`` in every n-th batch of a kind, but not within ``cooldown`` seconds of its last call."""

    def batch(found: DataFrame, number: int) -> None:
        held = Ledger(found.sparkSession, ledger)
        old, done = held.before(number)
        if done:
            return
        last = dict.fromkeys(periods, 0.0) | ({r["kind"]: r["fired"] for r in old.collect()} if old is not None else {})  # a row a kind
        for kind, n in periods.items():
            if (number + 1) % n == 0 and time.time() - last[kind] >= cooldown:
                run(kind, number + 1)
                last[kind] = time.time()
        held.write(number, found.sparkSession.createDataFrame(list(last.items()), "kind string, fired double"))

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drift_stream(observations: DataFrame, delta: float = 0.002) -> DataFrame:
    """(entity, at, kind) from a stream of (entity, cluster, at, value in [0, 1]): a change of the mean, or a reset.

    The window of an entity is its state across sweeps, logarithmic in what it has seen. It starts anew when the entity's
    cluster changes or the state cannot be read.
    """
    kinds = dict(observations.dtypes)

    def sweep(key, series: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, cluster = None, None
        if state.exists:
            text, cluster = state.get
            window = Adwin.load(text, delta)
        out = []
        for rows in series:
            for at, now, value in rows.sort_values("at")[["at", "cluster", "value"]].itertuples(index=False):
                if window is None or now != cluster:
                    if cluster is not None or state.exists:
                        out.append((key[0], at, "reset"))
                    window, cluster = Adwin(delta), now
                if window.add(min(1.0, max(0.0, float(value)))):
                    out.append((key[0], at, "change"))
        state.update((window.dump(), cluster))
        yield pd.DataFrame(out, columns=["entity", "at", "kind"])

    grouped = observations.select("entity", "cluster", "at", "value").groupBy("entity")
    return grouped.applyInPandasWithState(sweep, f"entity {kinds['entity']}, at {kinds['at']}, kind string", f"window string, cluster {kinds['cluster']}", "append", "NoTimeout")


def supersede(requests: DataFrame, registry: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Apply facts as they arrive: each batch gives the next version of the facts in ``store``, whatever their dates.

    A back-dated fact is judged by the overlap of validity alone, so no order of arrival is lost.
    """

    def batch(rows: DataFrame, number: int) -> None:
        held = Ledger(rows.sparkSession, store)
        old, done = held.before(number)
        if not done:
            held.write(number, create_facts(rows.limit(0) if old is None else old, rows, registry)[0])

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, store: str) -> DataFrame | None:
    return Ledger(spark, store).latest()


def new_speakers(turns: DataFrame, seen_at: str | None = None, keep: str = "7 days") -> DataFrame:
    """(stream_id, speaker_key), each once; with a time column, a pair is remembered for ``keep`` after it was met."""
    met = turns.filter(F.col("role").isin("user", "assistant"))
    names = [F.col("conv_id").alias("stream_id"), F.col("role").alias("speaker_key")]
    if seen_at is None:  # a bounded table of streams: state holds every pair
        return met.select(*names).dropDuplicates(["stream_id", "speaker_key"])
    timed = met.select(*names, F.col(seen_at).alias("seen_at")).withWatermark("seen_at", keep)
    return timed.dropDuplicatesWithinWatermark(["stream_id", "speaker_key"]).select("stream_id", "speaker_key")
