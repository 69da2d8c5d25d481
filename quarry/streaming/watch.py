"""Changes of files as a stream: an event log, debounced, applied in batches.

Events are rows (path, op, ts) that something appends to a folder. Within a batch the last
event of a burst counts; hashes are compared before anything is indexed, so replays and
late events do no harm.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.engine import Engine
from quarry.functions import paths
from quarry.schema import EVENTS
from quarry.sources.scan import scan, scan_paths

#: Pause that ends a burst; how late an event may come; seconds between rescans.
DEBOUNCE, LATE, RESCAN = "500 milliseconds", "10 minutes", 300.0
#: Files of the event log that a batch takes at most, so that a backlog comes in parts.
FILES_A_BATCH = 64


def read_events(spark: SparkSession, folder: str, format: str = "json", files: int = FILES_A_BATCH) -> DataFrame:
    return spark.readStream.schema(EVENTS).format(format).option("maxFilesPerTrigger", files).load(folder)


def debounce(events: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """(path, first_ts, last_ts, op, n_events) of each burst: events of a path less than gap apart."""
    bursts = events.groupBy(F.session_window("ts", gap), "path").agg(F.max_by("op", F.struct("ts", "op")).alias("op"), F.max("ts").alias("last_ts"), F.min("ts").alias("first_ts"), F.count("*").alias("n_events"))
    return bursts.select("path", "first_ts", "last_ts", "op", "n_events")


def debounced_stream(events: DataFrame, gap: str = DEBOUNCE, late: str = LATE) -> DataFrame:
    return debounce(events.withWatermark("ts", late), gap)


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path; of equal times the op that sorts last."""
    return events.groupBy("path").agg(F.max_by("op", F.struct("ts", "op")).alias("op"), F.max("ts").alias("ts"))


def wanted(events: DataFrame, engine: Engine, root: str) -> DataFrame:
    """Events of supported files that aren't ignored, judged below the watched root."""
    relative = paths.relative_to(F.col("path"), root)
    return events.where(engine.parsers.supports(F.col("path")) & ~engine.options.ignore.ignored_path(relative))


def apply_events(engine: Engine, batch: DataFrame, root: str) -> None:
    """Indexes files that exist and removes those that don't, in one write each, whatever the event says of them."""
    bursts = debounce(wanted(batch, engine, root)).select("path", "op", F.col("last_ts").alias("ts"))
    here, gone = _existing(engine.spark, [r.path for r in latest(bursts).select("path").collect()])  # a batch is bounded by the trigger
    if here:
        engine.index_scanned(scan_paths(engine.spark, here))
    if gone:
        engine.remove_paths(gone)


def _existing(spark: SparkSession, named: list[str]) -> tuple[list[str], list[str]]:
    """Paths of files that exist, and whole URIs of what doesn't; each folder above them is listed once."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders: dict[str, list[str]] = {}
    for p in named:
        folders.setdefault(p.rpartition("/")[0] or "/", []).append(p)
    here, gone = [], []
    for folder, own in folders.items():
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        found = {s.getPath().getName(): s.isDirectory() for s in fs.listStatus(path)} if fs.exists(path) else {}
        for p in own:
            name = p.rpartition("/")[2]
            if name not in found:
                gone.append(fs.makeQualified(jvm.org.apache.hadoop.fs.Path(p)).toString())
            elif not found[name]:
                here.append(p)
    return here, gone


def watch(engine: Engine, log: str, root: str, checkpoint: str, available_now: bool = False, interval: str = "500 milliseconds", late: str | None = None) -> StreamingQuery:
    """Starts the stream; it resumes from its checkpoint and ends with StreamingQuery.stop().

    A batch takes the last event of each burst in it. With late, a burst may span batches: it
    is held in state until the watermark, late behind the last event, has passed its end.
    """
    events = read_events(engine.spark, log)
    if late is not None:
        events = debounced_stream(events, late=late).select("path", "op", F.col("last_ts").alias("ts"))
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply_events(engine, batch, root))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


class FolderLog:
    """Writes the event log of a folder: what has come, changed or gone since the last look, ignored folders apart."""

    def __init__(self, engine: Engine, root: str, log: str):
        self.engine, self.root, self.log = engine, root, log
        self.known: dict[str, tuple[int, int]] = {}

    def look(self) -> int:
        """One look at the folder; the number of events written."""
        spark = self.engine.spark
        rows = scan(spark, self.root, self.engine.options.ignore, with_content=False).select("path", "size", F.unix_micros("modified_at").alias("at")).collect()
        now = {r.path: (r.size, r.at) for r in rows}
        events = [(p, "upsert") for p, state in now.items() if self.known.get(p) != state] + [(p, "delete") for p in self.known.keys() - now.keys()]
        if events:
            spark.createDataFrame(events, "path string, op string").withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").json(self.log)
        self.known = now
        return len(events)


@dataclass
class Progress:
    """What a background run is at."""

    path: str
    running: bool = False
    new_files: int = 0
    error: str | None = None


class Rescan:
    """Scans folders again and again in the background."""

    def __init__(self, engine: Engine, folders: list[str], seconds: float = RESCAN, full_sync: bool = False, on_error: Callable[[str, Exception], None] | None = None):
        self.engine, self.folders, self.seconds, self.full_sync, self.on_error = engine, folders, seconds, full_sync, on_error
        self.progress = {f: Progress(f) for f in folders}
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def run_once(self) -> None:
        for folder in self.folders:
            own = self.progress[folder]
            own.running, own.error = True, None
            try:
                own.new_files = self.engine.index_directory(folder, self.full_sync).first().new_files
            except Exception as e:  # noqa: BLE001 - the next folder is still scanned
                own.error = str(e)
                if self.on_error:
                    self.on_error(folder, e)
            finally:
                own.running = False

    def start(self) -> Rescan:
        def loop() -> None:
            while not self._stop.is_set():
                self.run_once()
                self._stop.wait(self.seconds)

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
