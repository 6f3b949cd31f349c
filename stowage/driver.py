"""What runs beside queries on the driver: locks, settings, ticks, progress, draining, and whether there is anything to do."""

from __future__ import annotations

import fcntl
import json
import os
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Locked(RuntimeError):
    """Another process holds the lock."""


@contextmanager
def locked(*paths: str) -> Iterator[None]:
    """Hold a lock on each file, or none of them; never wait. The files stay, so that no two processes lock different ones."""
    with ExitStack() as stack:
        for path in paths:
            f = stack.enter_context(open(path, "a"))
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError as e:
                raise Locked(path) from e
        yield


def seconds(text: str) -> float:
    """Of a duration such as 15m, 1h30m or 250ms."""
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ms|h|m|s)", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"no duration: {text!r}")
    return sum(float(n) * {"h": 3600, "m": 60, "s": 1, "ms": 0.001}[u] for n, u in parts)


@dataclass
class Settings:
    """Of a JSON file; intervals of 0 switch a cycle off, and a rate of 0 is none."""

    listen: str = ":8080"
    mirror_interval: float = 900.0
    gc_interval: float = 3600.0
    drain_timeout: float = 60.0
    parallelism: int = 8
    upstream_rate: float = 0.0
    repositories: list[dict] = field(default_factory=list)


def settings(path: str) -> Settings:
    """The settings and repositories (name, url and dir each) of a JSON file; durations that can't be read keep their default."""
    with open(path) as f:
        found = json.load(f)
    out = Settings(repositories=found.get("repos") or [])
    if not out.repositories:
        raise ValueError(f"{path} names no repository")
    for r in out.repositories:
        if missing := [k for k in ("name", "url", "dir") if not r.get(k)]:
            raise ValueError(f"repository {r.get('name')!r} lacks {', '.join(missing)}")
    out.listen = found.get("listen") or out.listen
    out.parallelism = found.get("parallelism") if (found.get("parallelism") or 0) > 0 else out.parallelism
    out.upstream_rate = found.get("upstream_rate") if (found.get("upstream_rate") or 0) > 0 else out.upstream_rate
    for name in ("mirror_interval", "gc_interval", "drain_timeout"):
        if found.get(name):
            try:
                setattr(out, name, seconds(found[name]))
            except ValueError:
                continue
    return out


def ticks(cycles: dict[str, tuple[float, Callable[[], object]]], stop: threading.Event, failed: Callable[[str, Exception], object] | None = None) -> dict[str, int]:
    """Run each cycle (seconds, action) at once and then at its interval until stop is set; none runs beside another. How often each ran.

    A cycle that fails is told to `failed` and comes again; one with an interval of 0 never runs.
    """
    due = {name: 0.0 for name, (every, _) in cycles.items() if every > 0}
    ran = dict.fromkeys(cycles, 0)
    while due and not stop.is_set():
        name = min(due, key=due.get)
        if stop.wait(max(0.0, due[name] - time.monotonic())):
            break
        every, action = cycles[name]
        due[name] = time.monotonic() + every
        try:
            action()
        except Exception as e:
            if failed is None:
                raise
            failed(name, e)
        ran[name] += 1
    return ran


def drained(spark: SparkSession, action: Callable[[], object], stop: threading.Event, grace: float = 60.0) -> tuple[object, bool]:
    """Result of action, and whether it ended. Once stop is set it has `grace` seconds more; then its jobs are cancelled.

    An action that advances its state as its last step (such as mirror()) has then changed none: its work is discarded.
    """
    out: dict[str, object] = {}
    group = f"drained-{uuid.uuid4().hex}"

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "may be drained", interruptOnCancel=True)
        try:
            out["result"] = action()
        except Exception as e:
            out["error"] = e

    thread = InheritableThread(target=run)
    thread.start()
    while thread.is_alive() and not stop.is_set():
        thread.join(0.05)
    thread.join(grace)
    cancelled = thread.is_alive()
    while thread.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        thread.join(0.2)
    if cancelled:
        return None, False
    if "error" in out:
        raise out["error"]
    return out["result"], True


@contextmanager
def progress(spark: SparkSession, report: Callable[[dict], object], every: float = 5.0) -> Iterator[None]:
    """Tell report, every so many seconds, how many tasks of the active stages are done, and how long the rest takes at this pace."""
    done, began = threading.Event(), time.monotonic()

    def watch() -> None:
        tracker = spark.sparkContext.statusTracker()
        while not done.wait(every):
            found = [i for i in map(tracker.getStageInfo, tracker.getActiveStageIds()) if i is not None]
            total, ended = sum(i.numTasks for i in found), sum(i.numCompletedTasks for i in found)
            report({"stages": len(found), "tasks": total, "done": ended, "seconds": time.monotonic() - began, "remaining": remaining_seconds(ended, total, time.monotonic() - began)})

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()


class StreamProgress(StreamingQueryListener):
    """Tells report the name, batch and rows of each batch of a streaming query, and what ended it."""

    def __init__(self, report: Callable[[dict], object]):
        self.report = report

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.report({"event": "started", "name": event.name})

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.report({"event": "batch", "name": p.name, "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.report({"event": "ended", "error": event.exception})


def manifest_changed(path: str, upstream: Callable[[], bytes], most: int = 256 * 1024) -> bool:
    """Whether the manifest upstream differs from the one here; if it can't be read, no; without one here, yes."""
    try:
        new = upstream()[:most]
    except OSError:
        return False
    if not os.path.exists(path):
        return True
    with open(path, "rb") as f:
        return f.read() != new


def remaining_seconds(done: int, total: int, seconds: float) -> float | None:
    """At the pace so far; unknown before anything is done."""
    return seconds * (total - done) / done if done else None
