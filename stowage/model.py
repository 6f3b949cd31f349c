"""Schemas and fixed values of the content-addressed object model.

A hash is 40 lower-case hex characters, a suffix one letter or '' for none, so that equality needs no null-safe test.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Kinds of objects by suffix.
SUFFIXES = {"": "content", "C": "catalog", "P": "partial chunk", "L": "micro-catalog", "H": "history", "X": "certificate", "M": "metainfo"}
# Flag bits of a catalog row.
FLAG_DIR, FLAG_FILE, FLAG_CHUNKED, FLAG_EXTERNAL = 1, 4, 64, 128
# Catalogs without a schema property, and the first schema with chunks.
DEFAULT_SCHEMA, CHUNK_SCHEMA = 2.5, 2.4
# Sizes at which objects stay loose, packs are full, and prefixes count as fragmented.
LOOSE_BYTES, PACK_ENTRIES, MERGE_ABOVE = 262_144, 599_148, 3
# The pack index file.
INDEX_MAGIC, INDEX_VERSION, INDEX_MOST = b"\xff\x74\x4f\x63", 2, 100_000_000


KINDS = {"string": T.StringType(), "long": T.LongType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def struct(text: str) -> T.StructType:
    """A schema from "name kind, ..." without need of a session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (x.split() for x in text.split(", "))])


ENTRY = struct("hash string, suffix string")
STORED = struct("hash string, suffix string, prefix string, path string, length long")
PACK_ENTRY = struct("pack_id string, prefix string, hash string, offset long, length long")
EDGE = struct("parent string, child string")
TAG = struct("name string, hash string, revision long")
CATALOG_ROW = struct("catalog_hash string, md5path_1 long, md5path_2 long, hash binary, size long, flags long, name string")
CHUNK_ROW = struct("catalog_hash string, md5path_1 long, md5path_2 long, offset long, size long, hash binary")
NESTED_ROW = struct("catalog_hash string, path string, sha1 string, size long")
PROPERTY_ROW = struct("catalog_hash string, key string, value string")
MANIFEST = struct("root string, size long, root_path string, history string, certificate string, metainfo string, revision long, collectable boolean, name string")
