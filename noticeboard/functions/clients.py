"""Request-log expressions: who called, and in which window."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from noticeboard.fixed_values import IP_HASH_CHARS
from noticeboard.functions.text import python_strip


def client_ip(forwarded: Column, peer: Column) -> Column:
    """First forwarded address, else the peer, else 'unknown'; a blank first entry stays blank."""
    return (F.when(F.coalesce(forwarded, F.lit("")) != "",
                   python_strip(F.split_part(forwarded, F.lit(","), F.lit(1))))
            .otherwise(F.coalesce(peer, F.lit("unknown"))))


def hash_ip(ip: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), ip), 256), 1, IP_HASH_CHARS)


def utc_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def utc_minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm")


def retry_after(ts: Column) -> Column:
    """Whole seconds until the next UTC midnight, at least 1."""
    micros = F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts))
    elapsed = F.ceil(micros / F.lit(1_000_000)).cast("long")
    return F.greatest(F.lit(1).cast("long"), F.lit(86400).cast("long") - elapsed)
