"""Timestamps from entry names and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_name(name: Column) -> Column:
    """The timestamp a name starts with, yyyymmdd-hhmmss with or without microseconds; null otherwise."""
    stamp = F.regexp_extract(name, r"^([0-9]{8}[-_][0-9]{6}(?:[-_][0-9]{6})?)", 1)
    plain = F.regexp_replace(stamp, "_", "-")
    micro = F.try_to_timestamp(plain, F.lit("yyyyMMdd-HHmmss-SSSSSS"))
    return F.coalesce(F.when(F.length(plain) == 22, micro), F.when(F.length(plain) == 15, F.try_to_timestamp(plain, F.lit("yyyyMMdd-HHmmss"))))


def entry_time(fields: list[Column], name: Column, modified: Column) -> Column:
    """The first metadata field that is a timestamp, else the name's, else the file's, else the epoch."""
    return F.coalesce(*[F.try_to_timestamp(x) for x in fields], from_name(name), modified, F.lit("1970-01-01").cast("timestamp"))


def shown_time(name: Column) -> Column:
    return F.coalesce(F.date_format(from_name(name), "yyyy-MM-dd HH:mm:ss"), name)
