"""The mutation log's model: tombstones, clocks, hashes and times as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A deletion is a write of this value.
TOMBSTONE = "__TOMBSTONE__"

#: key, value, physical_time (epoch ms), logical_counter, node_id
LOG_COLUMNS = ("key", "value", "physical_time", "logical_counter", "node_id")

#: Hashes are 60-bit prefixes of MD5, so that sums of a few never overflow a BIGINT.
RING = 1 << 60

MERKLE_BUCKETS = 16


def hash60(x: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 15), 16, 10).cast("bigint")


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a zoneless timestamp, fractions cut, whatever the session's zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return F.floor(micros / 1000).cast("bigint")


def hlc(prefix: str = "") -> Column:
    """The hybrid logical clock, ordered by its fields, then by value so that equal clocks resolve alike everywhere."""
    return F.struct(*[F.col(prefix + c) for c in ("physical_time", "logical_counter", "node_id", "value")])


def is_tombstone(value: Column) -> Column:
    return value == F.lit(TOMBSTONE)


def entry_hash(prefix: str = "") -> Column:
    """Hash of a whole log entry, field by field."""
    fields = [F.col(prefix + c).cast("string") for c in ("key", "value", "physical_time", "logical_counter", "node_id")]
    return hash60(F.concat_ws("|", *fields))


def state_json(value: str = "value", prefix: str = "") -> Column:
    """A register as JSON: its value and timestamp."""
    stamp = F.struct(*[F.col(prefix + c).alias(c) for c in ("physical_time", "logical_counter", "node_id")])
    return F.to_json(F.struct(F.col(prefix + value).alias("value"), stamp.alias("timestamp")))


def now_ms() -> Column:
    """The current time in epoch milliseconds, once for a query."""
    return F.unix_millis(F.current_timestamp())
