"""Weather feed values and free-text fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NO_RAIN = ("NIL", "TRACE", "TR")


def to_float(c: Column) -> Column:
    """A number, or null for blanks, text and NaN."""
    d = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(d), d)


def to_rain_mm(c: Column) -> Column:
    return F.when(F.upper(F.trim(c.cast("string"))).isin(*NO_RAIN), 0.0).otherwise(to_float(c))


def obs_timestamp(day: Column, time: Column) -> Column:
    """ISO time in UTC; a bare hour becomes HH:00:00; null if the day is missing."""
    day, time = F.trim(day.cast("string")), F.trim(time.cast("string"))
    clock = F.when(time.rlike("^\\d{1,2}$"), F.concat(F.lpad(time, 2, "0"), F.lit(":00:00"))).otherwise(time)
    return F.when((F.length(day) > 0) & (F.length(clock) > 0), F.concat(day, F.lit("T"), clock, F.lit("Z"))).otherwise(F.when(F.length(day) > 0, day))


def split_wards(c: Column) -> Column:
    """Ward numbers of a comma list; parts that are no ward from 1 to 144 go."""
    parts = F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), ","), lambda x: F.trim(x).try_cast("int"))
    return F.filter(parts, lambda x: x.between(1, 144))


def wards_valid(c: Column) -> Column:
    """Whether all parts of the list are wards."""
    return F.forall(F.split(c.cast("string"), ","), lambda x: F.coalesce(F.trim(x).try_cast("int").between(1, 144), F.lit(False)))


def base_id(c: Column) -> Column:
    """The location's id without its scenario suffix."""
    return F.regexp_replace(c, "__[A-Za-z0-9_]+$", "")


def parse_label(c: Column) -> Column:
    """diameter_mm from "300mm", "300 KEIIP" or inches, and scale from "SCALE 1:2,800"."""
    mm = F.regexp_extract(c, r"(?i)\b(\d{3,4})\s*(?:mm|KEIIP)\b", 1).try_cast("int")
    inches = F.regexp_extract(c, r"(?i)\b(\d{1,3}(?:\.\d+)?)\s*(?:\"|inch(?:es)?\b|in\b)", 1).try_cast("double")
    scale = F.regexp_replace(F.regexp_extract(c, r"(?i)SCALE\s*1\s*:\s*([\d,]+)", 1), ",", "").try_cast("int")
    return F.struct(F.coalesce(mm, F.round(inches * 25.4).cast("int")).alias("diameter_mm"), scale.alias("scale"))
