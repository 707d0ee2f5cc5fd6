"""Identifiers, splits and checks of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def serial_id(prefix: str, n: Column, digits: int = 8) -> Column:
    return F.format_string(f"{prefix}%0{digits}d", n)


def well_formed(key: Column, prefix: str) -> Column:
    """Starts with the prefix and goes on."""
    return F.coalesce(F.startswith(key, F.lit(prefix)) & (F.char_length(key) > len(prefix)), F.lit(False))


def hash_share(key: Column) -> Column:
    """A number in [0, 1] from the first 32 bits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def in_split(key: Column, share: float) -> Column:
    return hash_share(key) < share


def shard_by_suffix(key: Column, shards: int, digits: int = 6) -> Column:
    """The last digits of a key, modulo the number of shards; 0 without a digit."""
    number = F.regexp_replace(key.cast("string"), "[^0-9]", "")
    return F.pmod(F.when(number == "", 0).otherwise(F.right(F.concat(F.lit("0"), number), F.lit(digits)).cast("long")), F.lit(shards))


def finite(*values: Column) -> Column:
    """All present, and neither NaN nor infinite."""
    out = F.lit(True)
    for v in values:
        out = out & F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))
    return out


def opaque_id(prefix: str, *parts: Column) -> Column:
    """The prefix and the first 12 digits, in upper case, of the SHA-256 of the parts joined by `|`."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 12)))


def tile_key(z: Column, y: Column, x: Column) -> Column:
    return F.format_string("z%03d_y%03d_x%03d", z, y, x)


def tile_index(key: Column) -> Column:
    """The three numbers of a tile key, as an array; null for what is none."""
    found = F.regexp_extract_all(key, F.lit("[zyx]([0-9]+)"), F.lit(1)).cast("array<int>")
    return F.when(F.size(found) == 3, found)
