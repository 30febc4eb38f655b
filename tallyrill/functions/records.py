"""Scalar functions on records, names and sizes, as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

#: File extensions by format and by compression.
FORMAT_EXTENSIONS = {"cef": "cef", "leef": "leef", "json": "json", "jsonl": "jsonl", "syslog": "syslog", "raw": "txt"}
COMPRESSION_EXTENSIONS = {"gzip": "gz", "zstd": "zst", "none": ""}
#: Names that stand for a format, a compression or a source type.
ALIASES = {"ndjson": "jsonl", "gz": "gzip", "zst": "zstd", "syslog": "syslog_spool", "off": "none"}


def _finite(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError(text)
    return value


def _refuse(name: str):
    raise ValueError(name)


@pandas_udf(BooleanType())
def is_json(values: pd.Series) -> pd.Series:
    """Whether bytes are one JSON text: strict UTF-8, finite numbers, nothing after it."""

    def valid(value) -> bool:
        try:
            json.loads(bytes(value).decode("utf-8"), parse_constant=_refuse, parse_float=_finite)
        except (ValueError, RecursionError):
            return False
        return True

    return values.map(valid).astype(bool)


def detect_record(value: Column) -> Column:
    """The format family of one record, given as bytes; the order of the tests matters."""
    text = F.decode(value, "ISO-8859-1")  # one character a byte: no byte is lost or refused
    start = F.regexp_replace(text, r"^[ \t\n\x0c\r]+", "")
    opens = F.substring(start, 1, 1).isin("{", "[")
    return (
        F.when(value.isNull() | (start == ""), "raw")
        .when(start.startswith("CEF:") | F.contains(text, F.lit("CEF:0|")), "cef")
        .when(start.startswith("LEEF:") | F.contains(text, F.lit("LEEF:1.0|")) | F.contains(text, F.lit("LEEF:2.0|")), "leef")
        .when(start.rlike(r"^<[0-9]{1,3}>"), "syslog")
        # the parser sees only what opens like JSON; other rows hand it null bytes of no length
        .when(opens & is_json(F.when(opens, value).otherwise(F.lit(b""))), "jsonl")
        .otherwise("raw")
    )


def sanitize_token(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")


def sanitize_segment(c: Column) -> Column:
    """A path segment's safe form: no separators, no '..', never empty."""
    safe = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._=-]", "_"), r"\.\.", "_")
    return F.when(safe == "", "_").otherwise(safe)


def normalize_prefix(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "/"), lambda x: x != ""), "/")


def sanitize_bucket(c: Column, fallback: str = "telemetry") -> Column:
    safe = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(fallback))


def range_token(source_type: Column, partition: Column, start: Column, end: Column) -> Column:
    return F.when(source_type == "kafka", F.format_string("p%d-%d-%d", partition, start, end)).otherwise(F.format_string("b%d-%d", start, end))


def object_name(batch: Column, fmt: Column, compression: Column) -> Column:
    """``batch.format[.compression]``."""
    ext = _mapped(FORMAT_EXTENSIONS, fmt)
    packed = _mapped(COMPRESSION_EXTENSIONS, compression)
    return F.concat_ws(".", batch, ext, F.nullif(packed, F.lit("")))


def _mapped(table: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def compression_ratio(raw: Column, packed: Column) -> Column:
    return F.when(packed == 0, 1.0).otherwise(raw.cast("double") / F.nullif(packed, F.lit(0)))


def space_saved_pct(raw: Column, packed: Column) -> Column:
    return F.when(raw == 0, 0.0).otherwise((F.lit(1.0) - packed.cast("double") / F.nullif(raw, F.lit(0))) * 100.0)


def per_second(amount: Column, seconds: Column) -> Column:
    return F.when(seconds <= 0, 0.0).otherwise(amount.cast("double") / F.nullif(seconds, F.lit(0.0)))


BYTE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB")


def human_bytes(n: Column, largest: str = "TiB") -> Column:
    """B to ``largest`` with one decimal, halves to even; plain bytes without.

    The rounding is in longs: of a double, Spark rounds the shortest decimals, not the value.
    """
    out, last = F.when(n < 1024, F.format_string("%d B", n)), BYTE_UNITS.index(largest)
    value = n.cast("double").cast("long")  # what a double holds of it
    for k in range(1, last + 1):
        rest = value % 1024**k * 10
        tenths, twice = F.shiftright(rest, 10 * k), rest % 1024**k * 2
        tenths += F.when((twice > 1024**k) | (twice == 1024**k) & (tenths % 2 == 1), 1).otherwise(0)
        whole = F.shiftright(value, 10 * k) + F.when(tenths == 10, 1).otherwise(0)
        text = F.format_string(f"%d.%d {BYTE_UNITS[k]}", whole, tenths % 10)
        out = out.when(n < 1024 ** (k + 1) if k < last else n.isNotNull(), text)
    return out


def majority(n: Column) -> Column:
    return F.floor(n / 2) + 1


def valid_name(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9._-]{1,249}$")


def window_floor(latest: Column, width: int = 65_536) -> Column:
    return F.greatest(latest - (width - 1), F.lit(0))


def stem(base_offset: Column) -> Column:
    """A file stem whose text order is the order of offsets."""
    return F.format_string("range-%020d", base_offset)


def commit_position(source_type: Column, end: Column) -> Column:
    """Where reading goes on: after an inclusive offset, or at a byte end."""
    return F.when(source_type == "kafka", end + 1).otherwise(end)
