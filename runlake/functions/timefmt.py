"""Times: everything inside is UTC without a zone.

The driver-side functions serve the API and file names; the ``_column`` ones do the same in a plan.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "%Y%m%dT%H%M%SZ"
TOKEN_PATTERN = "yyyyMMdd'T'HHmmss'Z'"
RUN_ID = r"^\d{8}T\d{6}Z$"
LOCAL_ZONE = "Australia/Melbourne"


def naive_utc(value: datetime) -> datetime:
    """Aware times are moved to UTC; naive ones are UTC already."""
    return value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value


def parse(value: str | datetime, fmt: str) -> datetime:
    """A naive UTC time from a time or from text in exactly ``fmt`` (else ValueError); TypeError for anything else."""
    if isinstance(value, datetime):
        return naive_utc(value)
    if isinstance(value, str):
        return datetime.strptime(value, fmt)
    raise TypeError(f"a time or text is needed, not {type(value).__name__}")


def api_text(value: str | datetime | None, fmt: str) -> str | None:
    """What the API is sent: text that fits ``fmt`` unchanged, times formatted, None as None."""
    if value is None:
        return None
    parsed = parse(value, fmt)
    return value if isinstance(value, str) else parsed.strftime(fmt)


def new_run_id(clock: Callable[[], datetime] = lambda: datetime.now(UTC)) -> str:
    """UTC to the second, so that text order is time order."""
    return naive_utc(clock()).strftime(TOKEN)


def token(value: datetime | None) -> str:
    """A bound in a chunk's name; an absent one is ``open``."""
    return "open" if value is None else naive_utc(value).strftime(TOKEN)


def local_text(value: str | None, fmt: str, zone: str = LOCAL_ZONE) -> str | None:
    """UTC text as wall time with the zone's abbreviation, for people who read manifests."""
    if value is None:
        return None
    return datetime.strptime(value, fmt).replace(tzinfo=UTC).astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S %Z")


def steps(start: datetime, end: datetime, days: int) -> list[tuple[datetime, datetime]]:
    """The range in parts of ``days``, the last perhaps shorter; an empty range is one empty part."""
    bounds = [start]
    while bounds[-1] < end:
        bounds.append(min(bounds[-1] + timedelta(days=days), end))
    return list(zip(bounds, bounds[1:], strict=False)) or [(start, end)]


def text_column(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def token_column(c: Column) -> Column:
    return F.coalesce(F.date_format(c, TOKEN_PATTERN), F.lit("open"))


def hour_column(c: Column) -> Column:
    """date_trunc gives a zoned timestamp; back to a naive one."""
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def local_column(c: Column, zone: str = LOCAL_ZONE) -> Column:
    """Wall time in ``zone`` of a naive UTC time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c)


def zone_changes(zone: str = LOCAL_ZONE, first: int = 1970, last: int = 2100) -> list[tuple[datetime, str]]:
    """(UTC time from which it holds, short name) of a zone's times in these years, in order; found to the second by halving days."""
    name = lambda t: t.replace(tzinfo=UTC).astimezone(ZoneInfo(zone)).strftime("%Z")
    at, end = datetime(first, 1, 1), datetime(last + 1, 1, 1)
    out = [(at, name(at))]
    while at < end:
        after = at + timedelta(days=1)
        if name(after) != out[-1][1]:
            low, high = at, after
            while high - low > timedelta(seconds=1):
                middle = low + timedelta(seconds=int((high - low).total_seconds()) // 2)
                low, high = (low, middle) if name(middle) != out[-1][1] else (middle, high)
            out.append((high, name(after)))
        at = after
    return out


def with_zone_name(df: DataFrame, column: str, name: str, zone: str = LOCAL_ZONE, first: int = 1970, last: int = 2100) -> DataFrame:
    """``df`` with the short name of ``zone``'s time at a naive UTC time; null outside these years.

    The zone's times are a small table with a row for each month that they touch, so the look-up is a broadcast hash join on the month
    with the bounds as its condition."""
    changes = zone_changes(zone, first, last)
    ends = [*(at for at, _ in changes[1:]), datetime(last + 1, 1, 1)]
    rows = []
    for (low, told), high in zip(changes, ends, strict=True):
        months = range(low.year * 12 + low.month, (high - timedelta(microseconds=1)).year * 12 + (high - timedelta(microseconds=1)).month + 1)
        rows += [(m, low, high, told) for m in months]
    taken = {c.lower() for c in df.columns}
    month, low_, high_ = (next(x for x in (base + "_" * k for k in range(len(taken) + 1)) if x not in taken) for base in ("month", "low", "high"))
    table = df.sparkSession.createDataFrame(rows, f"`{month}` int, `{low_}` timestamp_ntz, `{high_}` timestamp_ntz, `{name}` string")
    t = F.col(f"`{column}`")
    within = (F.year(t) * 12 + F.month(t) == table[month]) & (t >= table[low_]) & (t < table[high_])
    return df.join(F.broadcast(table), within, "left").drop(month, low_, high_)


def steps_column(start: Column, end: Column, days: int) -> Column:
    """The parts of a range as an array of structs (chunk_start, chunk_end)."""
    width = F.expr(f"interval {int(days)} days")
    last = F.greatest(start, end - F.expr("interval 1 microsecond"))
    return F.transform(F.sequence(start, last, width), lambda s: F.struct(s.alias("chunk_start"), F.least(s + width, end).alias("chunk_end")))
