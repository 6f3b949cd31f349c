import json
import os
import threading
import time

import pytest

from stowage import driver, streaming


def test_locks(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    with driver.locked(a, b):
        with pytest.raises(driver.Locked), driver.locked(b):
            pass
    with driver.locked(a, b):
        pass
    with driver.locked(b):
        with pytest.raises(driver.Locked), driver.locked(a, b):
            pass
        with driver.locked(a):  # let go when b could not be had
            pass


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"repos": [{"name": "n", "url": "u", "dir": "d"}]}))
    found = driver.settings(str(path))
    assert found.repositories[0]["url"] == "u" and (found.listen, found.mirror_interval, found.gc_interval, found.drain_timeout, found.parallelism) == (":8080", 900, 3600, 60, 8)
    path.write_text(json.dumps({"listen": ":9", "mirror_interval": "1h30m", "gc_interval": "250ms", "drain_timeout": "soon", "parallelism": 3, "upstream_rate": 2.5, "repos": [{"name": "n", "url": "u", "dir": "d"}]}))
    found = driver.settings(str(path))
    assert (found.listen, found.mirror_interval, found.gc_interval, found.drain_timeout, found.parallelism, found.upstream_rate) == (":9", 5400, 0.25, 60, 3, 2.5)
    path.write_text(json.dumps({"repos": [{"name": "n", "url": "u"}]}))
    with pytest.raises(ValueError, match="dir"):
        driver.settings(str(path))
    path.write_text("{}")
    with pytest.raises(ValueError, match="no repository"):
        driver.settings(str(path))


def test_ticks():
    stop, ran, errors = threading.Event(), [], []

    def once(name):
        ran.append(name)
        if len(ran) > 8:
            stop.set()
        if name == "b":
            raise OSError("broken")

    counts = driver.ticks({"a": (0.01, lambda: once("a")), "b": (0.02, lambda: once("b")), "c": (0, lambda: once("c"))}, stop, lambda n, e: errors.append((n, str(e))))
    assert counts["a"] >= counts["b"] >= 2 and counts["c"] == 0 and set(errors) == {("b", "broken")}


def test_drain_and_progress(spark, tmp_path):
    """A run that is stopped changes no state; one that ends in its grace does."""
    state, told = [], []

    def slow(seconds):
        spark.range(4, numPartitions=4).mapInPandas(lambda it: (time.sleep(seconds) or x for x in it), "id long").count()
        state.append(seconds)
        return "done"

    stop = threading.Event()
    with driver.progress(spark, told.append, every=0.2):
        assert driver.drained(spark, lambda: slow(1), stop) == ("done", True)
    assert any(t["tasks"] >= 4 for t in told)
    threading.Timer(0.5, stop.set).start()
    assert driver.drained(spark, lambda: slow(60), stop, grace=0.5) == (None, False) and state == [1]
    assert driver.drained(spark, lambda: slow(0.1), stop, grace=30) == ("done", True) and state == [1, 0.1]
    with pytest.raises(ZeroDivisionError):
        driver.drained(spark, lambda: 1 / 0, threading.Event())


def test_stream_progress(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a").write_text("Caa\nS1")
    told, seen = [], []
    listener = driver.StreamProgress(told.append)
    spark.streams.addListener(listener)
    try:
        streaming.watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda m, k: seen.append(m["root"]), name="manifests").awaitTermination(60)
        for _ in range(100):
            if any(t["event"] == "ended" for t in told):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert seen == ["aa"] and [t for t in told if t["event"] == "batch" and t["rows"] == 1 and t["name"] == "manifests"] and told[-1] == {"event": "ended", "error": None}


def test_manifest_probe(tmp_path):
    path = tmp_path / "m"
    assert driver.manifest_changed(str(path), lambda: b"x")
    path.write_bytes(b"x")
    assert not driver.manifest_changed(str(path), lambda: b"x") and driver.manifest_changed(str(path), lambda: b"y")

    def fails():
        raise OSError

    assert not driver.manifest_changed(str(path), fails)
    assert driver.remaining_seconds(0, 5, 1) is None and driver.remaining_seconds(2, 6, 3) == 6
