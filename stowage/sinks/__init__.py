"""Writers. What removes or replaces files is a dry run unless it is told otherwise, and may be repeated."""

from __future__ import annotations

import json
import os
import struct
import time
import uuid
from collections.abc import Callable, Iterator
from hashlib import sha1, sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage import functions as fn
from stowage import model, plans, sources
from stowage.operators import windows
from stowage.session import materialise


def write_entries(entries: DataFrame, path: str) -> None:
    """Distinct entries as Parquet by prefix, in order within each file."""
    df = entries.select("hash", "suffix").dropDuplicates().withColumn("prefix", fn.prefix(F.col("hash")))
    df.repartitionByRange("hash").sortWithinPartitions("prefix", "hash", "suffix").write.mode("overwrite").partitionBy("prefix").parquet(path)


def write_chunks(entries: DataFrame, folder: str, dedup: bool = True) -> list[str]:
    """chunk-XX files of sorted 21-byte records; folder must be one that all executors see. Empty prefixes have no file."""
    df = entries.select(fn.prefix(F.col("hash")).alias("p"), fn.to_binary(F.col("hash"), F.col("suffix")).alias("e"))
    df = df.distinct() if dedup else df
    df = df.repartition("p").sortWithinPartitions("p", "e")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        done, out, name = [], None, None
        for batch in batches:
            for p, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != name:
                    done += _close(out)
                    name, out = p, open(os.path.join(folder, f".chunk-{p}-{uuid.uuid4().hex}"), "wb")  # noqa: SIM115
                out.write(e)
        done += _close(out)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    os.makedirs(folder, exist_ok=True)
    out = []
    for row in materialise(df.mapInArrow(write, "path string")).collect():  # one a prefix: 256 at most
        final = os.path.join(folder, "chunk-" + os.path.basename(row["path"]).split("-")[1])
        os.replace(row["path"], final)
        out.append(final)
    return sorted(out)


def _close(f) -> list[str]:
    if f is None:
        return []
    f.flush()
    os.fsync(f.fileno())
    f.close()
    return [f.name]


def write_list(candidates: DataFrame, path: str) -> None:
    """One hash with suffix a line, in any order."""
    candidates.select(fn.full_name(F.col("hash"), F.col("suffix")).alias("value")).write.mode("overwrite").text(path)


def delete_files(candidates: DataFrame, really: bool = False) -> DataFrame:
    """path and outcome (planned, deleted, absent or failed) of each candidate (path). A second try finds absent what the first deleted."""
    plan = materialise(candidates.select("path", "length", "suffix"))
    if not really:
        return plan.withColumn("outcome", F.lit("planned"))

    def unlink(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                try:
                    os.unlink(path.removeprefix("file:"))
                    out.append("deleted")
                except FileNotFoundError:
                    out.append("absent")
                except OSError:
                    out.append("failed")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "outcome"])

    return materialise(plan.mapInArrow(unlink, "path string, length long, suffix string, outcome string"))


def index_bytes(entries: list[tuple[str, int, int]], pack_sha1: bytes) -> bytes:
    """A pack index of entries (hash, offset, length) in order of hash."""
    if any(length >> 32 for _, _, length in entries):
        raise ValueError("an object of 4 GiB or more can't be indexed")
    names = [bytes.fromhex(h) for h, _, _ in entries]
    if names != sorted(names):
        raise ValueError("entries are not in order")
    fan = [0] * 256
    for x in names:
        fan[x[1]] += 1
    for i in range(1, 256):
        fan[i] += fan[i - 1]
    wide = [o for _, o, _ in entries if o >> 31]
    place = iter(range(len(wide)))
    short = [o if not o >> 31 else 1 << 31 | next(place) for _, o, _ in entries]
    n = len(entries)
    body = model.INDEX_MAGIC + struct.pack(">I256I", model.INDEX_VERSION, *fan) + b"".join(names) + struct.pack(f">{n}I{n}I{len(wide)}Q", *(x for _, _, x in entries), *short, *wide) + pack_sha1
    return body + sha1(body).digest()


def write_packs(layout: DataFrame, packs_dir: str) -> list[dict]:
    """Packs from layout (prefix, pack_no, hash, new_offset, length, content): named by their bytes, index last.

    One task appends the objects of a pack in order and never holds more than one. Nothing has its final name before
    all tasks have ended; then packs are renamed, then indices. packs_dir must be a folder that all executors see.
    """
    ordered = layout.repartition("prefix", "pack_no").sortWithinPartitions("prefix", "pack_no", "new_offset").select("prefix", "pack_no", "hash", "new_offset", "length", "content")
    run = uuid.uuid4().hex

    def append(batches: Iterator) -> Iterator:
        import pyarrow as pa

        done, state = [], None

        def finish() -> None:
            if state:
                path = _close(state["file"])[0]
                index = index_bytes(sorted(state["entries"]), state["sha1"].digest())
                with open(path + ".idx", "wb") as f:
                    f.write(index)
                    f.flush()
                    os.fsync(f.fileno())
                done.append((state["key"][0], state["sha256"].hexdigest(), path, len(state["entries"]), state["size"]))

        for batch in batches:
            for prefix, pack_no, hash_, offset, length, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state["key"] != (prefix, pack_no):
                    finish()
                    os.makedirs(os.path.join(packs_dir, prefix), exist_ok=True)
                    f = open(os.path.join(packs_dir, prefix, f"pack.tmp-{run}-{uuid.uuid4().hex}"), "wb")  # noqa: SIM115
                    state = {"key": (prefix, pack_no), "file": f, "sha1": sha1(), "sha256": sha256(), "entries": [], "size": 0}
                if len(content) != length or state["size"] != offset:
                    raise ValueError(f"object {hash_} does not fit its place")
                state["file"].write(content)
                state["sha1"].update(content)
                state["sha256"].update(content)
                state["entries"].append((hash_, offset, length))
                state["size"] += length
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["prefix", "pack_id", "path", "entries", "bytes"])

    try:
        rows = [r.asDict() for r in materialise(ordered.mapInArrow(append, "prefix string, pack_id string, path string, entries long, bytes long")).collect()]
        for r in rows:
            final = os.path.join(packs_dir, r["prefix"], r["pack_id"])
            os.replace(r["path"], final + ".pack")
            os.replace(r["path"] + ".idx", final + ".idx")
        return rows
    finally:
        remove_orphans(packs_dir, run)


def remove_orphans(packs_dir: str, run: str = "") -> int:
    """Unfinished packs below packs_dir go; of one run, or of all."""
    n = 0
    for folder, _, names in os.walk(packs_dir):
        for name in names:
            if name.startswith(f"pack.tmp-{run}" if run else "pack.tmp"):
                os.unlink(os.path.join(folder, name))
                n += 1
    return n


def drop_packs(stale: DataFrame, written: list[dict], packs_dir: str, really: bool = False) -> list[str]:
    """Packs of stale (prefix, pack_id) that are not among the new ones: their index goes first."""
    new = {(r["prefix"], r["pack_id"]) for r in written}
    gone = []
    for row in stale.select("prefix", "pack_id").distinct().toLocalIterator():
        if (row["prefix"], row["pack_id"]) not in new:
            base = os.path.join(packs_dir, row["prefix"], row["pack_id"])
            gone.append(base)
            for path in (base + ".idx", base + ".pack") if really else ():
                if os.path.exists(path):
                    os.unlink(path)
    return gone


def apply_cycle(cycle: plans.Cycle, packs_dir: str, status: str | None = None, really: bool = False) -> dict[str, int]:
    """Write the new packs of plans.server_cycle(), drop stale ones, delete unreachable loose objects (path), note the time in status."""
    plan = cycle.compaction
    if not really:
        return {"packs_written": 0, "packs_dropped": len(drop_packs(plan.stale, [], packs_dir)), "loose_deleted": plan.loose.where("not kept").count()}
    contents = sources.read_objects(plan.layout.select("prefix", "pack_id", "pack_no", "hash", "new_offset", "offset", "length"), packs_dir)
    written = write_packs(contents, packs_dir)
    gone = drop_packs(plan.stale, written, packs_dir, really=True)
    deleted = delete_files(plan.loose.where("not kept").select("path", "length", fn.suffix_of_name(F.col("name")).alias("suffix")), really=True)
    out = {"packs_written": len(written), "packs_dropped": len(gone), "loose_deleted": deleted.where("outcome = 'deleted'").count()}
    if status:
        now = cycle.stats.sparkSession.range(1).select(fn.utc_stamp(F.current_timestamp()).alias("t")).first()["t"]
        write_status(status, last_gc=now)
    return out


def write_objects(objects: DataFrame, data_dir: str, packs_dir: str, per_pack: int = model.PACK_ENTRIES) -> list[dict]:
    """Write objects (hash, suffix, length, outcome, content) where their outcome says: loose ones as files, small ones in packs, once a hash."""
    write_loose(objects.where("outcome = 'loose'"), data_dir)
    small = objects.where("outcome = 'packed'").select("hash", "length", "content").dropDuplicates(["hash"])
    layout = windows.pack_layout(small.select("hash", "length"), per_pack).withColumnRenamed("offset", "new_offset")
    return write_packs(layout.join(small.select("hash", "content"), "hash"), packs_dir)


def write_loose(objects: DataFrame, data_dir: str) -> DataFrame:
    """hash, suffix and length of objects (hash, suffix, content), each written beside its place and renamed."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lengths = []
            for hash_, suffix, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                os.makedirs(os.path.join(data_dir, hash_[:2]), exist_ok=True)
                final = os.path.join(data_dir, hash_[:2], hash_[2:] + suffix)
                temporary = f"{final}.{uuid.uuid4().hex}"
                with open(temporary, "wb") as f:
                    f.write(content)
                os.replace(temporary, final)
                lengths.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int64())], ["hash", "suffix", "length"])

    return materialise(objects.select("hash", "suffix", "content").mapInArrow(write, "hash string, suffix string, length long"))


def save_processed(hashes: DataFrame, path: str) -> None:
    """One hash a line, in order, as a new version of the state at path; it counts from the moment it is whole, and older ones go then."""
    spark = hashes.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = sources.state_versions(spark, path)
    n = max([int(p[-12:]) for p in old], default=0) + 1
    new = f"{path}/processed-{n:012d}"
    fs.delete(jvm(new), True)  # one that was not finished
    hashes.select("hash").distinct().orderBy("hash").write.text(new)
    if not fs.exists(jvm(f"{new}/_SUCCESS")):
        raise OSError(f"{new} was not finished")
    for p in old:
        fs.delete(jvm(p), True)


def write_status(path: str, **values: object) -> dict:
    """Merge values into a JSON file."""
    status = {}
    if os.path.exists(path):
        with open(path) as f:
            status = json.load(f)
    status |= values
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "w") as f:
        json.dump(status, f, indent=2)
    os.replace(temporary, path)
    return status


def timed(report: dict, name: str, action: Callable[[], object]) -> object:
    """Run action and note its seconds in report."""
    began = time.monotonic()
    out = action()
    report[name] = time.monotonic() - began
    return out
