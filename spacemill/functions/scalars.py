"""Text and number helpers: sizes, ranges, prefixes, hex, flags, configuration values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# open(2) flags in the order they are printed.
OPEN_FLAGS = [("O_CREAT", 0o100), ("O_EXCL", 0o200), ("O_TRUNC", 0o1000), ("O_DIRECT", 0o40000), ("O_APPEND", 0o2000), ("O_RDWR", 0o2), ("O_WRONLY", 0o1)]


def string_to_size(s: Column) -> Column:
    """128K is 131072: a whole number with an optional K, M or G in either case, powers of 1024. Other texts give null."""
    n = F.regexp_extract(s, r"^\s*([0-9]+)\s*([KkMmGg]?)\s*$", 1)
    unit = F.upper(F.regexp_extract(s, r"^\s*([0-9]+)\s*([KkMmGg]?)\s*$", 2))
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1).cast("long")
    return F.when(n != "", n.try_cast("long") * factor)


def split_string(s: Column, delimiter: str) -> Column:
    """Split at a literal delimiter; one empty token at the end is dropped, so an empty text gives none."""
    parts = F.split(s, re.escape(delimiter))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def expand_range(s: Column) -> Column:
    """1-5,8 is [1,2,3,4,5,8]: sorted, repeats kept; a reversed range is empty."""

    def token(t: Column) -> Column:
        lo, hi = F.split(t, "-")[0].try_cast("long"), F.element_at(F.split(t, "-"), -1).try_cast("long")
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    return F.array_sort(F.flatten(F.transform(split_string(s, ","), token)))


def common_prefix(lo: Column, hi: Column) -> Column:
    """The longest prefix of two texts; of a group's least and greatest it is that of the whole group."""
    n = F.least(F.length(lo), F.length(hi))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(lo, F.lit(1), i) == F.substring(hi, F.lit(1), i))
    return F.substring(lo, F.lit(1), F.array_max(same))


def longest_common_prefix(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, prefix. Least and greatest combine before the shuffle, so no group is gathered."""
    return df.groupBy(key).agg(F.min(text).alias("_lo"), F.max(text).alias("_hi")).select(key, common_prefix(F.col("_lo"), F.col("_hi")).alias("prefix"))


def hex_number(v: Column, digits: int = 0) -> Column:
    h = F.hex(v)
    return F.concat(F.lit("0x"), F.when(F.length(h) < digits, F.lpad(h, digits, "0")).otherwise(h))


def hex_string(b: Column, most: int = 64) -> Column:
    """0x and the bytes as hex with a space after each 8 bytes; beyond ``most`` a note of how many more."""
    b = b.cast("binary")
    shown = F.hex(F.substring(b, F.lit(1), F.lit(most)))
    spaced = F.rtrim(F.regexp_replace(shown, "(.{16})", "$1 "))
    more = F.octet_length(b) - most
    return F.concat(F.lit("0x"), spaced, F.when(more > 0, F.concat(F.lit(" ("), more.cast("string"), F.lit(" more bytes)"))).otherwise(""))


def flags_to_text(flags: Column, delimiter: str = "|") -> Column:
    return F.concat_ws(delimiter, *[F.when(flags.bitwiseAND(bit) != 0, name) for name, bit in OPEN_FLAGS])


def unique_name(model: Column) -> Column:
    """Each % of the model is a random hex digit."""
    parts = F.split(model, "%")
    digit = F.substring(F.md5(F.uuid()), 1, 32)
    n = F.size(parts)
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.get(parts, i), F.when(i < n - 1, F.substring(digit, F.pmod(i, F.lit(32)) + 1, F.lit(1))).otherwise("")))
    return F.array_join(pieces, "")


def config_value(value: Column, default: Column | None = None, required: str | None = None) -> Column:
    """A present value, else the default; where neither is there and the tag is required, an error."""
    if default is not None:
        return F.coalesce(value, default)
    return F.coalesce(value, F.raise_error(F.lit(f"missing configuration element: {required}"))) if required else value


def config_enum(value: Column, allowed: list[int], tag: str) -> Column:
    """A value of the enumeration, else an error."""
    return F.when(value.isin(allowed), value).otherwise(F.raise_error(F.concat(F.lit(f"invalid enumeration value of {tag}: "), value.cast("string"))).cast("int"))
