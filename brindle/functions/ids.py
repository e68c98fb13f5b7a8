"""Column expressions for hex ids and UTC months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_id(col: Column | str, digits: int) -> Column:
    """The id a reference names, as plain lower-case hex of ``digits`` digits; null if it refers to nothing.

    Tags (``rev:``), a leading ``0x``, padding and case are ignored: ids are equal if their last ``digits`` hex digits
    are. Null, an empty or blank string and one of only zeros refer to nothing. A shorter id stays as short as it is.
    """
    c = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^[a-z_]+:", ""), r"^0x|[^0-9a-f]", "")
    last = F.substring(bare, -digits, digits)
    last = F.when(F.length(bare) <= digits, bare).otherwise(last)
    return F.when(~last.rlike("^0*$"), last)


def month_utc(ts: Column | str) -> Column:
    """``YYYY-MM`` of a timestamp in UTC, whatever the session's time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM")


def month_of_ms(ms: Column | str) -> Column:
    c = F.col(ms) if isinstance(ms, str) else ms
    return month_utc(F.timestamp_millis(c))
