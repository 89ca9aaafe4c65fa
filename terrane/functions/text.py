"""Text, JSON, bit and array helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64_url(data: Column) -> Column:
    """Base 64 in the URL alphabet."""
    return F.translate(F.base64(data), "+/", "-_")


def unbase64_url(text: Column) -> Column:
    return F.unbase64(F.translate(text, "-_", "+/"))


def find(text: Column, part: str, last: bool = False) -> Column:
    """Place of part in text from 0, of its last occurrence if asked; -1 if there is none."""
    if not last:
        return F.instr(text, F.lit(part)) - 1
    back = F.instr(F.reverse(text), F.lit(part[::-1]))
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(text) - back - (len(part) - 1))


def to_long(text: Column) -> Column:
    """Whole number of decimal or 0x-prefixed text; null if it is none."""
    hexed = F.conv(F.substring(text, 3, 64), 16, 10).try_cast("long")
    return F.when(F.lower(F.substring(text, 1, 2)) == "0x", hexed).otherwise(text.try_cast("long"))


def to_double(text: Column) -> Column:
    return text.try_cast("double")


def to_bool(text: Column) -> Column:
    return F.lower(text).isin("true", "1", "yes", "on")


def printable(text: Column) -> Column:
    """Characters outside the printable ASCII range are left out."""
    return F.regexp_replace(text, "[^\\x20-\\x7E]", "")


def urlize(text: Column) -> Column:
    return F.url_encode(text)


def name_like(text: Column, name: str, exact: bool = False) -> Column:
    """SQL LIKE of a name in which % and _ are plain characters."""
    plain = name.replace("$", "$$").replace("%", "$%").replace("_", "$_")
    return like(text, plain if exact else f"%{plain}%")


def orbit_pattern(rgt: int | None, cycle: int | None, region: int | None) -> str:
    """LIKE pattern of a resource name with its track, cycle and region; missing parts match any digits."""
    part = lambda v, n: "_" * n if v is None else str(v).zfill(n)
    return f"%$_{part(rgt, 4)}{part(cycle, 2)}{part(region, 2)}$_%"


def like(text: Column, pattern: str, escape: str = "$") -> Column:
    return F.like(text, F.lit(pattern), F.lit(escape))


def bit_set(flag: Column, mask: int) -> Column:
    """Whether bit number `flag` of mask is set; flags over 7 raise, mask 0 lets everything pass."""
    if mask == 0:
        return F.lit(True)
    bad = F.raise_error(F.concat(F.lit("flag out of range: "), flag.cast("string"))).cast("boolean")
    # one bit of a literal each, as shifts by a column need its value at planning time
    hit = F.lit(False)
    for k in range(8):
        if mask >> k & 1:
            hit = hit | (flag == k)
    return F.when((flag < 0) | (flag > 7), bad).otherwise(hit)


def pad_list(values: Column, n: int, fill: float = 0.0) -> Column:
    """First n values; shorter lists are filled up."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), n)), 1, n)


def pack_extent_id(rgt: Column, cycle: Column, region: Column, track: Column, pair: Column, counter: Column) -> Column:
    """One long of the parts, from bits 52, 36, 32, 30 and 2 on; the pair takes bit 0."""
    low = counter.cast("long").bitwiseAND(0xFFFFFFF)
    out = pair.cast("long")
    for value, place in ((rgt, 52), (cycle, 36), (region, 32), (track, 30), (low, 2)):
        out = out.bitwiseOR(F.shiftleft(value.cast("long"), place))
    return out


def spot_number(orientation: Column, track: Column, pair: Column) -> Column:
    """Spot 1 to 6 of a spacecraft orientation (0 backward, 1 forward), track 1 to 3 and pair 0 or 1; 0 if it is turning."""
    k = (track - 1) * 2 + pair
    return F.when(orientation == 0, k + 1).when(orientation == 1, 6 - k).otherwise(F.lit(0)).cast("int")


def ground_track(orientation: Column, track: Column, pair: Column) -> Column:
    """Ground track 10 to 60; 0 if the spacecraft is turning."""
    return F.when(orientation.isin(0, 1), ((track - 1) * 2 + pair + 1) * 10).otherwise(F.lit(0)).cast("int")


def granule_parts(name: Column) -> Column:
    """Date, track, cycle, region and versions of a name like PRODUCT_yyyymmddhhmmss_ttttccrr_vvv_ss.h5."""
    part = lambda k: F.regexp_extract(name, r"^(\w+?)_(\d{4})(\d{2})(\d{2})(\d{6})_(\d{4})(\d{2})(\d{2})_(\d{3})_(\d{2})", k)
    numbers = {"year": 2, "month": 3, "day": 4, "rgt": 6, "cycle": 7, "region": 8, "version": 9}
    return F.struct(part(1).alias("product"), *[F.try_to_number(part(k), F.lit("9999")).cast("int").alias(n) for n, k in numbers.items()])


def companion(name: Column, product: str) -> Column:
    """The name of another product's file for the same granule."""
    return F.regexp_replace(name, r"^[A-Z]+\d+", product)
