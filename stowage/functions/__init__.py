"""Column functions over hashes, suffixes, flags and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage import model

HEX40 = r"^[0-9a-fA-F]{40}"


def full_name(hash_: Column, suffix: Column) -> Column:
    """hash with its suffix."""
    return F.concat(hash_, suffix)


def object_path(hash_: Column, suffix: Column) -> Column:
    """XX/rest with suffix; a hash under three characters stays as it is, without its suffix."""
    return F.when(F.length(hash_) < 3, hash_).otherwise(F.concat(F.substring(hash_, 1, 2), F.lit("/"), F.substr(hash_, F.lit(3)), suffix))


def prefix(hash_: Column) -> Column:
    return F.substring(hash_, 1, 2)


def to_binary(hash_: Column, suffix: Column) -> Column:
    """21 bytes: the hash and one byte of suffix, 0 for none; null if the hash isn't 40 hex characters."""
    raw = F.unhex(F.when(hash_.rlike(HEX40 + "$"), hash_))
    return F.concat(raw, F.when(suffix == "", F.unhex(F.lit("00"))).otherwise(suffix.cast("binary")))


def from_binary(entry: Column) -> tuple[Column, Column]:
    """hash and suffix of a 21-byte record."""
    last = F.substring(entry, 21, 1)
    return F.lower(F.hex(F.substring(entry, 1, 20))), F.when(F.hex(last) == "00", "").otherwise(last.cast("string"))


def suffix_of_name(name: Column) -> Column:
    """The last character if it is A to Z, else none."""
    return F.regexp_extract(name, r"([A-Z])$", 1)


def without_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"[A-Z]$", "")


def hash_of_name(name: Column) -> Column:
    """The first 40 characters if they are hex, else null."""
    return F.when(name.rlike(HEX40), F.substring(name, 1, 40))


def is_external(flags: Column) -> Column:
    return flags.bitwiseAND(model.FLAG_EXTERNAL) != 0


def is_named(hash_: Column) -> Column:
    return F.coalesce(F.octet_length(hash_) > 0, F.lit(False))


def content_suffix(flags: Column) -> Column:
    """L for a directory that is no file, else none."""
    return F.when((flags.bitwiseAND(model.FLAG_DIR) != 0) & (flags.bitwiseAND(model.FLAG_FILE) == 0), "L").otherwise("")


def size_class(length: Column, threshold: int = model.LOOSE_BYTES) -> Column:
    return F.when(length >= threshold, "loose").otherwise("packed")


def is_collectable(value: Column) -> Column:
    """Of a manifest's G value; without one, yes."""
    return F.coalesce(value.isin("yes", "true", "1"), F.lit(True))


def percentage(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def human_bytes(n: Column) -> Column:
    """Bytes in units of 1024, one decimal."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate("KMGTPE", 1):
        scaled = n / F.lit(1024.0**power)
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", F.bround(scaled, 1)), F.lit(f" {unit}B"))).otherwise(out)
    return out


def suffix_label(suffix: Column) -> Column:
    out = F.lit("other")
    for key, label in model.SUFFIXES.items():
        out = F.when(suffix == key, label).otherwise(out)
    return out


def _utc(timestamp: Column) -> Column:
    """The time in UTC without a zone, to the second, whatever the session's zone is and does to its clocks."""
    seconds = F.floor(F.unix_micros(timestamp.cast("timestamp")) / 1_000_000).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def _clock(utc: Column) -> Column:
    return F.substr(utc.cast("string"), F.lit(12), F.lit(8))


def utc_stamp(timestamp: Column) -> Column:
    """Such as Thu Jan 1 00:00:00 UTC 1970."""
    day = F.to_date(_utc(timestamp))
    return F.concat(F.date_format(day, "EEE MMM d "), _clock(_utc(timestamp)), F.date_format(day, " 'UTC' yyyy"))


def rfc3339(timestamp: Column) -> Column:
    return F.concat(F.date_format(F.to_date(_utc(timestamp)), "yyyy-MM-dd"), F.lit("T"), _clock(_utc(timestamp)), F.lit("Z"))


def url_object(path: Column) -> tuple[Column, Column, Column]:
    """Of .../data/XX/rest: the prefix, the full name, and its hash without a 41st character; null if it has no such form."""
    two, rest = F.regexp_extract(path, r"/data/([0-9a-fA-F]{2})/([^/]+)$", 1), F.regexp_extract(path, r"/data/([0-9a-fA-F]{2})/([^/]+)$", 2)
    name = F.nullif(F.concat(two, rest), F.lit(""))
    return F.nullif(two, F.lit("")), name, F.when(F.length(name) == 41, F.substring(name, 1, 40)).otherwise(name)


def repository_name(path: Column) -> Column:
    """The first part of a url path."""
    return F.split_part(F.regexp_replace(path, "^/+", ""), F.lit("/"), F.lit(1))
