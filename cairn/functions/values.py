"""Column functions: text forms of values, buckets, percentiles, checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_text(value: Column) -> Column:
    """What an index compares: strings as they are, others as text, null as 'null'."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def folded_text(value: Column) -> Column:
    """Case-insensitive text form; null stays null and so never matches."""
    return F.lower(value.cast("string"))


def joined_key(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def decade(value: Column) -> Column:
    """Start of the ten that holds an integer."""
    return value - F.pmod(value, F.lit(10))


def nearest_rank(value: str, p: float) -> Column:
    """Percentile by nearest rank: the ceil(n*p)-th smallest."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)")


def duration_text(nanos: Column) -> Column:
    """Nanoseconds as ns, µs, ms or s."""
    return (
        F.when(nanos < 1_000, F.format_string("%d ns", nanos.cast("long")))
        .when(nanos < 1_000_000, F.format_string("%.2f µs", nanos / 1_000))
        .when(nanos < 1_000_000_000, F.format_string("%.2f ms", nanos / 1_000_000))
        .otherwise(F.format_string("%.2f s", nanos / 1_000_000_000))
    )


def rate_text(per_second: Column) -> Column:
    """Operations a second, in thousands or millions where large."""
    return (
        F.when(per_second >= 1_000_000, F.format_string("%.2f M/s", per_second / 1_000_000))
        .when(per_second >= 1_000, F.format_string("%.2f K/s", per_second / 1_000))
        .otherwise(F.format_string("%.2f /s", per_second.cast("double")))
    )


def bloom_positions(key: Column, bits: int = 131_072) -> Column:
    """Bit positions of a key in a run's Bloom filter: two CRC-32s, seeded with four
    bytes, and their sum."""
    one, two = (F.crc32(F.concat(F.lit(seed.to_bytes(4, "little")), key.cast("binary"))) for seed in (0, 1))
    return F.array(*[F.pmod(h, F.lit(bits)) for h in (one, two, one + two)])


def entry_size(key: Column, value: Column) -> Column:
    """Bytes an entry takes in memory: key, value and an eight-byte sequence number."""
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + 8
