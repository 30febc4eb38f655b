"""Paths from templates, storage addresses, times and ledger positions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .records import normalize_prefix, sanitize_segment


def resolve_template(template: str, values: dict[str, Column], at: Column) -> Column:
    """``{key}`` parts from columns or the hour of ``at``; unknown keys are empty, values made safe."""
    clock = {"yyyy": "yyyy", "mm": "MM", "dd": "dd", "hh": "HH"}  # the session's time zone is UTC
    parts: list[Column] = []
    for k, piece in enumerate(re.split(r"\{([^{}]*)\}", template)):
        if k % 2 == 0:
            parts.append(F.lit(piece))
        elif piece in clock:
            parts.append(F.date_format(at, clock[piece]))
        elif piece in values:
            given = F.coalesce(values[piece].cast("string"), F.lit(""))
            parts.append(F.when(given == "", "").otherwise(sanitize_segment(given)))
    return normalize_prefix(F.concat(*parts))


def bucket_of(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, r"^s3://([^/]+)/?", 1), F.lit(""))


def key_of(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, r"^s3://[^/]+/(.+)$", 1), F.lit(""))


def utc_text(stamp: Column) -> Column:
    """A time with an offset as UTC text of fixed width, so texts compare as times; it raises on others."""
    return F.date_format(F.to_timestamp(stamp), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def end_position(progress: Column) -> Column:
    """The end that a progress document states, in bytes or as an offset; -1 without one."""
    return F.coalesce(F.get_json_object(progress, "$.end_byte").cast("long"), F.get_json_object(progress, "$.end_offset").cast("long"), F.lit(-1).cast("long"))


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\|", r"\\\\|"), r"[\r\n]+", " ")
