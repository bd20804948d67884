"""Epoch seconds as doubles: reading and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted forms of a point in time; without a zone they are in UTC.
FORMS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy-MM-dd"]


def timestamp_epoch(raw: Column) -> Column:
    """A number (milliseconds above 1e10) or an ISO time, else null."""
    text = F.trim(raw)
    number = text.try_cast("double")
    iso = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in FORMS])
    return F.when(number.isNotNull(), F.when(number > 1e10, number / 1000).otherwise(number)).otherwise(F.unix_micros(iso) / F.lit(1e6))


def format_timestamp(epoch: Column) -> Column:
    whole = F.floor(epoch) + F.when(F.rint((epoch - F.floor(epoch)) * 1e6) >= 1e6, 1).otherwise(0)
    return F.when(epoch.isNull(), "-").otherwise(F.date_format(F.timestamp_seconds(whole), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
