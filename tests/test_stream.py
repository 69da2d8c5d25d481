"""Streams of file changes."""

import json
import time
from datetime import datetime, timedelta

from quarry.engine import Engine
from quarry.streaming.watch import FolderLog, Rescan, debounce, debounced_stream, latest, read_events, watch

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(p, op, T0 + timedelta(seconds=s)) for p, op, s in rows], "path string, op string, ts timestamp")


def test_debounce_and_latest(spark):
    df = events(spark, [("a", "upsert", 0.0), ("a", "delete", 0.3), ("a", "upsert", 2.0), ("b", "upsert", 0.0), ("b", "delete", 0.0)])
    got = sorted((r.path, r.op, r.n_events) for r in debounce(df).collect())
    assert got == [("a", "delete", 2), ("a", "upsert", 1), ("b", "upsert", 2)]
    assert {r.path: r.op for r in latest(df).collect()} == {"a": "upsert", "b": "upsert"}


def write_log(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"path": p, "op": op, "ts": (T0 + timedelta(seconds=s)).isoformat()}) for p, op, s in rows))


def test_debounced_stream(spark, tmp_path):
    write_log(tmp_path / "log", "1.json", [("a", "upsert", 0.0), ("a", "delete", 0.2), ("z", "upsert", 10_000)])
    query = debounced_stream(read_events(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert [(r.path, r.op, r.n_events) for r in spark.table("bursts").collect()] == [("a", "delete", 2)]


def test_watch_applies_changes_and_resumes(spark, tmp_path):
    root, log = tmp_path / "files", tmp_path / "log"
    root.mkdir()
    engine = Engine(spark, str(tmp_path / "index"))
    text = root / "a.txt"
    text.write_text("A first version of a text that is long enough to keep.")
    (root / ".hidden.txt").write_text("A hidden file that is long enough but must not be seen.")
    write_log(log, "1.json", [(str(text), "upsert", 0), (str(root / ".hidden.txt"), "upsert", 0), (str(root / "x.zzz"), "upsert", 0), (str(root), "upsert", 1)])

    def drain():
        watch(engine, str(log), str(root), str(tmp_path / "cp"), available_now=True).awaitTermination()

    drain()
    assert [r.path.rpartition("/")[2] for r in engine.list_files().collect()] == ["a.txt"]
    n = len(engine.store.versions())
    write_log(log, "2.json", [(str(text), "upsert", 5)])
    drain()  # nothing has changed, so nothing is written
    assert len(engine.store.versions()) == n
    text.unlink()
    write_log(log, "3.json", [(str(text), "upsert", 9)])
    drain()
    assert engine.list_files().count() == 0


def test_a_folder_writes_its_own_log(spark, tmp_path):
    """What comes, changes and goes is logged, and the log is all that watching needs."""
    root, log = tmp_path / "files", tmp_path / "log"
    (root / "node_modules").mkdir(parents=True)
    engine = Engine(spark, str(tmp_path / "index"))
    for name in ("a.txt", "b.txt", "node_modules/c.txt"):
        (root / name).write_text(f"The first words of {name}, and enough of them to be kept.")
    folder = FolderLog(engine, str(root), str(log))

    def drain():
        watch(engine, str(log), str(root), str(tmp_path / "cp"), available_now=True).awaitTermination()
        return sorted(r.path.rpartition("/")[2] for r in engine.list_files().collect())

    assert folder.look() == 2 and folder.look() == 0
    assert drain() == ["a.txt", "b.txt"]
    (root / "a.txt").unlink()
    (root / "d.txt").write_text("A file that came later, with words enough to be kept.")
    assert folder.look() == 2 and drain() == ["b.txt", "d.txt"]


def test_bursts_that_span_batches(spark, tmp_path):
    """With a lateness, events wait for the watermark; a batch takes a bounded number of log files."""
    root, log = tmp_path / "files", tmp_path / "log"
    root.mkdir()
    (root / "a.txt").write_text("A text that is long enough to be kept by the filter.")
    engine = Engine(spark, str(tmp_path / "index"))
    write_log(log, "1.json", [(str(root / "a.txt"), "upsert", 0.0)])
    write_log(log, "2.json", [(str(root / "a.txt"), "upsert", 0.3), (str(root / "later.txt"), "upsert", 100)])
    watch(engine, str(log), str(root), str(tmp_path / "cp"), available_now=True, late="1 second").awaitTermination()
    assert engine.list_files().count() == 1


def test_rescan(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    (root / "a.txt").write_text("A text that is long enough to be kept by the filter.")
    engine = Engine(spark, str(tmp_path / "index"))
    failed = []
    job = Rescan(engine, [str(root), str(tmp_path / "absent")], seconds=0.05, on_error=lambda f, e: failed.append(f)).start()
    for _ in range(600):
        if failed and job.progress[str(root)].new_files == 0 and engine.store.versions():
            break
        time.sleep(0.1)
    job.stop()
    assert engine.list_files().count() == 1 and failed and job.progress[str(tmp_path / "absent")].error
