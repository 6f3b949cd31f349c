"""Readers of manifests, object folders, catalogs, tags, pack indices and chunk files."""

from __future__ import annotations

import os
import sqlite3
import struct
import time
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha1

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage import functions as fn
from stowage import model
from stowage.session import materialise, release


class BadManifest(ValueError):
    """A manifest without a root."""


class BadIndex(ValueError):
    """A pack index that can't be trusted."""


class BadDatabase(ValueError):
    """A catalog or history that is no database."""


# Manifest keys and what they hold.
MANIFEST_KEYS = {"C": "root", "B": "size", "R": "root_path", "H": "history", "X": "certificate", "M": "metainfo", "S": "revision", "G": "collectable", "N": "name"}


def parse_manifests(texts: DataFrame) -> DataFrame:
    """A row of the manifest's fields for each text of texts (path, text): lines of a key and a value, the last of a key counts.

    extras holds hash and suffix of every history, certificate and metainfo line, as a manifest keeps them all alive.
    What follows a line that begins with `--` is a signature and no field. Null texts have no root, like any other
    without one: see read_manifest.
    """
    body = F.regexp_extract(F.concat(F.lit("\n"), F.coalesce("text", F.lit(""))), r"(?s)^(.*?)(?:\n--.*)?$", 1)
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, "\r$", "")), lambda x: F.length(x) >= 2)
    df = texts.withColumn("__l", lines)
    value = lambda key: F.substr(F.element_at(F.filter("__l", lambda x: x.startswith(key)), -1), F.lit(2))
    safe = lambda key: F.when(F.size(F.filter("__l", lambda x: x.startswith(key))) > 0, value(key))
    types = {"size": "long", "revision": "long"}
    columns = [(fn.is_collectable(safe(k)) if name == "collectable" else safe(k).try_cast(types[name]) if name in types else safe(k)).alias(name) for k, name in MANIFEST_KEYS.items()]
    extras = F.transform(F.filter("__l", lambda x: F.substring(x, 1, 1).isin("H", "X", "M")), lambda x: F.struct(F.substr(x, F.lit(2)).alias("hash"), F.substring(x, 1, 1).alias("suffix")))
    return df.select("path", *columns, extras.alias("extras"))


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """path, hash and suffix of what each of parse_manifests()'s rows keeps alive: its root, and every other entry it names."""
    root = F.when(F.col("root").isNotNull(), F.array(F.struct(F.col("root").alias("hash"), F.lit("C").alias("suffix"))))
    return manifests.select("path", F.explode(F.concat(F.coalesce(root, F.slice("extras", 1, 0)), "extras")).alias("e")).select("path", "e.hash", "e.suffix")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The fields of one manifest; without a root it is refused."""
    texts = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))
    row = parse_manifests(texts).first()
    if row is None or not row["root"]:
        raise BadManifest(f"{path} names no root")
    return row.asDict()


def manifest_roots(manifest: dict) -> list[tuple[str, str]]:
    """Entries that a manifest itself keeps alive: its root, and every history, certificate and metainfo."""
    return [(manifest["root"], "C"), *((e["hash"], e["suffix"]) for e in manifest["extras"])]


def prefixes(spark: SparkSession) -> DataFrame:
    """00 to ff, in as many partitions as there are cores, up to one each."""
    return spark.range(256, numPartitions=min(256, max(8, spark.sparkContext.defaultParallelism))).select(F.lower(F.lpad(F.hex("id"), 2, "0")).alias("prefix"))


LISTED = T.StructType([*model.struct("prefix string, path string, length long, name string"), T.StructField("error", T.StringType())])


def list_objects(spark: SparkSession, data_dir: str) -> DataFrame:
    """prefix, path, length, name (prefix and file name) and error of the files in data_dir/XX/, listed by a task for each prefix.

    A folder that isn't there has no files; one that can't be read has one row with the error. data_dir must be a
    folder that all executors see.
    """
    root = data_dir.removeprefix("file://")

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(prefix: str) -> Iterator[tuple]:
            try:
                with os.scandir(os.path.join(root, prefix)) as found:
                    yield from ((prefix, f.path, f.stat(follow_symlinks=False).st_size, prefix + f.name, None) for f in found if f.is_file(follow_symlinks=False))
            except FileNotFoundError:
                return
            except OSError as e:
                yield (prefix, None, None, None, str(e))

        for batch in batches:
            for prefix in batch.column(0).to_pylist():
                yield from _tables(rows(prefix), LISTED)
        yield from _tables(iter(()), LISTED)

    return prefixes(spark).mapInArrow(scan, LISTED)


def _tables(rows: Iterator[tuple], schema: T.StructType, many: int = 10_000) -> Iterator:
    """Arrow batches of so many rows."""
    from itertools import batched

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    for part in batched(rows, many):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)


def loose_objects(spark: SparkSession, data_dir: str) -> DataFrame:
    """Stored objects below data_dir/XX/: only names and sizes are read. list_objects() tells which folders can't be."""
    named = list_objects(spark, data_dir).where("error is null")
    return named.select(fn.without_suffix(F.col("name")).alias("hash"), fn.suffix_of_name(F.col("name")).alias("suffix"), "prefix", "path", "length", "name")


def chunk_prefix(path: Column) -> Column:
    """XX of a path that ends in chunk-XX, else null."""
    return F.nullif(F.regexp_extract(path, r"chunk-([0-9a-f]{2})$", 1), F.lit(""))


def read_chunks(spark: SparkSession, path: str, of: list[str] | None = None) -> DataFrame:
    """Entries of files of 21-byte records: of one file, or of a folder's chunk-XX files, all or those of the prefixes `of`."""
    files = spark.read.format("binaryFile").load([f"{path}/chunk-{p}" for p in of] if of is not None else path)
    records = files.select(F.explode(F.transform(F.sequence(F.lit(0), F.greatest((F.col("length") / 21).cast("int") - 1, F.lit(0))), lambda i: F.substring(F.col("content"), i * 21 + 1, F.lit(21)))).alias("e"))
    hash_, suffix = fn.from_binary(F.col("e"))
    return records.where(F.octet_length("e") == 21).select(hash_.alias("hash"), suffix.alias("suffix"))


def inflated(data: bytes) -> bytes:
    """A SQLite file, which may be compressed."""
    try:
        data = data if data[:16] == b"SQLite format 3\x00" else zlib.decompress(data)
    except zlib.error as e:
        raise BadDatabase("neither SQLite nor zlib") from e
    if data[:16] != b"SQLite format 3\x00":
        raise BadDatabase("no SQLite file")
    return data


class Database:
    """One opening of a database; rows of queries come as they are read."""

    def __init__(self, data: bytes):
        self.db = sqlite3.connect(":memory:")
        try:
            self.db.deserialize(inflated(data))
            self.db.execute("SELECT count(*) FROM sqlite_master")
        except sqlite3.DatabaseError as e:
            raise BadDatabase(str(e)) from e

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.db.close()

    def rows(self, sql: str) -> Iterator[tuple]:
        try:
            yield from self.db.execute(sql)
        except sqlite3.DatabaseError as e:
            raise BadDatabase(str(e)) from e

    def has(self, table: str) -> bool:
        return self.db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone() is not None

    def version(self) -> float:
        """The schema of a catalog; without one it counts as 2.5."""
        found = next(self.rows("SELECT value FROM properties WHERE key = 'schema'"), None) if self.has("properties") else None
        return float(found[0]) if found else model.DEFAULT_SCHEMA


# Tables of a catalog and their columns.
CATALOG_TABLES = {
    "catalog": (model.CATALOG_ROW, "SELECT md5path_1, md5path_2, hash, size, flags, name FROM catalog"),
    "chunks": (model.CHUNK_ROW, "SELECT md5path_1, md5path_2, offset, size, hash FROM chunks"),
    "nested_catalogs": (model.NESTED_ROW, "SELECT path, sha1, size FROM nested_catalogs"),
    "properties": (model.PROPERTY_ROW, "SELECT key, value FROM properties"),
}
#: What a catalog names, by kind: filters, suffixes and the join of chunks with their files are SQLite's work.
NAMED = {
    "content": f"SELECT lower(hex(hash)), iif(flags & {model.FLAG_DIR} AND NOT flags & {model.FLAG_FILE}, 'L', '') FROM catalog WHERE length(hash) > 0 AND NOT flags & {model.FLAG_EXTERNAL}",
    "chunk": f"SELECT lower(hex(part.hash)), 'P' FROM chunks AS part JOIN catalog AS file USING (md5path_1, md5path_2) WHERE length(part.hash) > 0 AND NOT file.flags & {model.FLAG_EXTERNAL}",
    "nested": "SELECT lower(sha1), 'C' FROM nested_catalogs WHERE length(sha1) > 0",
}
NAMED_ROW = model.struct("catalog_hash string, kind string, hash string, suffix string")


def _read_each(files: DataFrame, rows: Callable[[str, bytes], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """rows(hash, content) of each of files (hash, content), in Arrow batches."""

    def read(batches: Iterator) -> Iterator:
        for batch in batches:
            for hash_, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _tables(rows(hash_, content.as_py()), schema)

    return files.select("hash", "content").mapInArrow(read, schema)


def catalog_refs(files: DataFrame) -> DataFrame:
    """catalog_hash, kind (content, chunk or nested), hash and suffix of all that the catalogs in files (hash, content) name.

    Each catalog is opened once. One that can't be read ends the run. Before schema 2.4 there are no chunks, whatever the table holds.
    """

    def rows(hash_: str, content: bytes) -> Iterator[tuple]:
        with Database(content) as db:
            for kind, sql in NAMED.items():
                if kind != "chunk" or db.version() >= model.CHUNK_SCHEMA:
                    for found, suffix in db.rows(sql):
                        yield (hash_, kind, found, suffix)

    return _read_each(files, rows, NAMED_ROW)


def catalog_table(files: DataFrame, table: str) -> DataFrame:
    """Rows of one table of the catalogs in files (hash, content), as they are. A catalog that can't be read ends the run."""
    schema, sql = CATALOG_TABLES[table]

    def rows(hash_: str, content: bytes) -> Iterator[tuple]:
        with Database(content) as db:
            if table != "chunks" or db.version() >= model.CHUNK_SCHEMA:
                for found in db.rows(sql):
                    yield (hash_, *found)

    return _read_each(files, rows, schema)


def history_tags(files: DataFrame) -> DataFrame:
    """name, hash and revision of the tags of history databases; one without a table of tags has none."""

    def rows(hash_: str, content: bytes) -> Iterator[tuple]:
        with Database(content) as db:
            if db.has("tags"):
                yield from db.rows("SELECT DISTINCT name, hash, revision FROM tags WHERE hash IS NOT NULL")

    return _read_each(files, rows, model.TAG)


def file_reader(data_dir: str) -> Callable[[str, str], bytes]:
    """Read objects (hash, suffix) below a folder that all executors see."""
    root = data_dir.removeprefix("file://")

    def read(hash_: str, suffix: str) -> bytes:
        with open(os.path.join(root, hash_[:2], hash_[2:] + suffix), "rb") as f:
            return f.read()

    return read


class HttpError(OSError):
    """An answer that isn't 200."""


def http_reader(base_url: str, timeout: float = 30.0, tries: int = 3, per_second: float | None = None) -> Callable[[str, str], bytes]:
    """Read objects (hash, suffix) from base_url/data/XX/rest. Anything but status 200 is an error, tried anew unless it is the client's.

    per_second bounds the requests of each task; with `tasks` of a fetch the rate of all is bounded.
    """
    last = [0.0]

    def read(hash_: str, suffix: str) -> bytes:
        url = f"{base_url}/data/{hash_[:2]}/{hash_[2:]}{suffix}"
        for turn in range(tries):
            if per_second:
                time.sleep(max(0.0, last[0] + 1 / per_second - time.monotonic()))
                last[0] = time.monotonic()
            try:
                with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
                    if answer.status != 200:
                        raise HttpError(f"{url}: {answer.status}")
                    return answer.read()
            except OSError as e:
                status = getattr(e, "code", None)
                if turn + 1 == tries or (status is not None and 400 <= status < 500):
                    raise HttpError(f"{url}: {e}") from e
                time.sleep(min(0.1 * 2**turn, 5.0))
        raise HttpError(url)

    return read


def catalog_files(hashes: DataFrame, read: Callable[[str, str], bytes]) -> DataFrame:
    """hash and content of the catalogs of hashes, by file_reader(), http_reader() or any other; each must be there.

    Only what is asked for is opened, and contents stay on the executors.
    """

    def load(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for h in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([read(h, "C")], pa.binary())], ["hash", "content"])

    return hashes.select("hash").distinct().mapInArrow(load, "hash string, content binary")


def parse_index(data: bytes):
    """An Arrow table of hash, offset and length of a pack index; anything wrong is refused, not skipped."""
    import numpy as np
    import pyarrow as pa

    if len(data) < 1072 or data[:4] != model.INDEX_MAGIC or struct.unpack(">I", data[4:8])[0] != model.INDEX_VERSION:
        raise BadIndex("no pack index of this version")
    if sha1(data[:-20]).digest() != data[-20:]:
        raise BadIndex("checksum differs")
    fan = np.frombuffer(data, ">u4", 256, 8)
    n = int(fan[-1])
    if n > model.INDEX_MOST or (np.diff(fan.astype("int64")) < 0).any() or len(data) < 1072 + 28 * n:
        raise BadIndex("counts are wrong")
    # hex digits of all names at once, as the values of one string array
    names = np.frombuffer(data[1032 : 1032 + 20 * n].hex().encode(), "uint8")
    hashes = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype="int32") * 40), pa.py_buffer(names))
    lengths = np.frombuffer(data, ">u4", n, 1032 + 20 * n).astype("int64")
    offsets = np.frombuffer(data, ">u4", n, 1032 + 24 * n).astype("int64")
    wide = np.frombuffer(data[1032 + 28 * n : len(data) - 40 - (len(data) - 1072 - 28 * n) % 8], ">u8").astype("int64")
    far = offsets >> 31 == 1
    at = offsets[far] & 0x7FFFFFFF
    if len(at) and at.max() >= len(wide):
        raise BadIndex("wide offset is missing")
    offsets[far] = wide[at]
    return pa.table({"hash": hashes, "offset": offsets, "length": lengths})


INDEX_FILE = model.struct("pack_id string, prefix string, path string, status string, size long, changed long, hash string, offset long, length long")


def list_packs(spark: SparkSession, packs_dir: str) -> DataFrame:
    """pack_id, prefix, path, size, changed (nanoseconds) and has_pack of the indices in packs_dir/XX/, listed by a task for each prefix."""
    root, schema = packs_dir.removeprefix("file://"), T.StructType([*model.struct("pack_id string, prefix string, path string, size long, changed long, has_pack boolean")])

    def scan(batches: Iterator) -> Iterator:
        for batch in batches:
            for prefix in batch.column(0).to_pylist():
                try:
                    with os.scandir(os.path.join(root, prefix)) as listed:
                        found = {f.name: f for f in listed}
                except FileNotFoundError:
                    continue
                stat = {k: f.stat() for k, f in found.items() if k.endswith(".idx")}
                yield from _tables(((k[:-4], prefix, found[k].path, s.st_size, s.st_mtime_ns, k[:-4] + ".pack" in found) for k, s in sorted(stat.items())), schema)

    return prefixes(spark).mapInArrow(scan, schema)


def read_indices(listed: DataFrame, strict: bool = False) -> DataFrame:
    """Entries of the indices of list_packs()'s rows: status is loaded, empty, corrupt or orphan (an index without its pack); but loaded ones are one row.

    With strict a corrupt one ends the run.
    """

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["pack_id", "prefix", "path", "status", "size", "changed", "hash", "offset", "length"]
        for batch in batches:
            get = {k: batch.column(i).to_pylist() for i, k in enumerate(batch.schema.names)}
            for pack_id, prefix, path, size, changed, has_pack in zip(*(get[k] for k in ("pack_id", "prefix", "path", "size", "changed", "has_pack")), strict=True):
                status, table = "orphan", None
                if has_pack:
                    try:
                        with open(path, "rb") as f:
                            table = parse_index(f.read())
                        status = "loaded" if len(table) else "empty"
                    except FileNotFoundError:
                        continue  # gone since the listing
                    except BadIndex as e:
                        if strict:
                            raise BadIndex(f"{path}: {e}") from e
                        status = "corrupt"
                if table is None or not len(table):
                    table = pa.table({"hash": pa.array([None], pa.string()), "offset": pa.array([None], pa.int64()), "length": pa.array([None], pa.int64())})
                for part in table.to_batches(65_536):
                    same = lambda v, t: pa.repeat(pa.scalar(v, t), part.num_rows)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(pack_id, pa.string()), same(prefix, pa.string()), same(path, pa.string()), same(status, pa.string()), same(size, pa.int64()), same(changed, pa.int64()), *part.columns], names)

    return listed.select("pack_id", "prefix", "path", "size", "changed", "has_pack").mapInArrow(rows, INDEX_FILE)


def pack_entries(spark: SparkSession, packs_dir: str, strict: bool = True) -> DataFrame:
    """Entries of all pack indices below packs_dir/XX/, as they are listed at this call.

    A corrupt index ends the run with strict, and is left out without; indices without their pack are always left out.
    """
    return read_indices(list_packs(spark, packs_dir), strict).where("status = 'loaded'").select(*model.PACK_ENTRY.names)


class PackStore:
    """Entries of the packs below packs_dir, kept between refreshes."""

    def __init__(self, spark: SparkSession, packs_dir: str):
        self.spark, self.packs_dir = spark, packs_dir
        self.table = materialise(spark.createDataFrame([], INDEX_FILE))

    def refresh(self) -> dict[str, int]:
        """Read indices that are new or changed, keep those that are loaded, drop those that are gone; counts of each, and of corrupt and orphan ones."""
        listed = materialise(list_packs(self.spark, self.packs_dir))
        key = ["path", "size", "changed"]
        had = self.table.select(*key, "status").distinct()
        usable = listed.where("has_pack")
        kept = self.table.join(usable.select(*key), key, "left_semi").select(INDEX_FILE.names)
        fresh = materialise(read_indices(listed.join(had.where("status != 'orphan'"), key, "left_anti")))
        new = materialise(kept.where("status != 'orphan'").unionByName(fresh))
        count = lambda df: df.select(*key).distinct().count()
        out = {"kept": count(kept.where("status = 'loaded'")), "dropped": count(had.where("status = 'loaded'").join(usable.select(*key), key, "left_anti")), "added": count(fresh.where("status = 'loaded'")), "corrupt": count(new.where("status = 'corrupt'")), "orphans": count(new.where("status = 'orphan'"))}
        release(self.table, fresh, listed)
        self.table = new
        return out

    def entries(self) -> DataFrame:
        return self.table.where("status = 'loaded'").select(*model.PACK_ENTRY.names)


def read_objects(entries: DataFrame, packs_dir: str, most_bytes: int = 8 << 20) -> DataFrame:
    """entries (pack_id, prefix, offset, length, ...) with content; a task opens a pack once and reads its rows in order.

    packs_dir must be a folder that all executors see. A batch holds most_bytes, or one object.
    """
    ordered = entries.repartition("prefix", "pack_id").sortWithinPartitions("prefix", "pack_id", "offset")
    root, schema = packs_dir.removeprefix("file://"), T.StructType([*entries.schema.fields, T.StructField("content", T.BinaryType())])

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        name, pack = None, None
        try:
            for batch in batches:
                get = {k: batch.column(i).to_pylist() for i, k in enumerate(batch.schema.names)}
                begin, contents, size = 0, [], 0
                for i in range(batch.num_rows):
                    if name != (get["prefix"][i], get["pack_id"][i]):
                        name = (get["prefix"][i], get["pack_id"][i])
                        if pack is not None:
                            pack.close()
                        pack = open(os.path.join(root, name[0], name[1] + ".pack"), "rb")  # noqa: SIM115
                    pack.seek(get["offset"][i])
                    content = pack.read(get["length"][i])
                    if len(content) != get["length"][i]:
                        raise BadIndex(f"pack {name[1]} is too short")
                    if contents and size + len(content) > most_bytes:
                        yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(contents)).columns, pa.array(contents, pa.binary())], schema.names)
                        begin, contents, size = i, [], 0
                    contents.append(content)
                    size += len(content)
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(contents)).columns, pa.array(contents, pa.binary())], schema.names)
        finally:
            if pack is not None:
                pack.close()

    return ordered.mapInArrow(read, schema)


#: A state is in folders of rising number below its path; the last one whose writing has ended counts.
VERSION = r"^processed-(\d{12})$"


def state_versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of a state's finished versions, in order."""
    import re

    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path(path)):
        return []
    found = [s.getPath() for s in fs.listStatus(jvm_path(path))]
    return sorted(p.toString() for p in found if re.match(VERSION, p.getName()) and fs.exists(jvm_path(p, "_SUCCESS")))


def processed_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """hash of each line of a text table, or of the last version of a state; none if there is no such path."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], "hash string")
    if versions := state_versions(spark, path):
        path = versions[-1]
    elif fs.getFileStatus(jvm_path).isDirectory() and not any(s.isFile() for s in fs.listStatus(jvm_path)):
        return spark.createDataFrame([], "hash string")  # the first version was never finished
    return spark.read.text(path).select(F.trim("value").alias("hash")).where("hash <> ''").distinct()
