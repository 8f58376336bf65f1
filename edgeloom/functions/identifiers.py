"""Column functions on path-like identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_identifier(path: Column | str) -> Column:
    """Trimmed, ``\\`` as ``/``, without empty and ``.`` segments, ``..`` resolved.

    A leading ``/`` stays; a leading ``..`` stays in a relative path and is dropped
    in an absolute one.
    """
    flat = F.replace(F.trim(_col(path)), F.lit("\\"), F.lit("/"))
    absolute = flat.startswith("/")
    parts = F.filter(F.split(flat, "/"), lambda s: (s != "") & (s != "."))

    def step(stack: Column, part: Column) -> Column:
        top = F.try_element_at(stack, F.lit(-1))
        can_pop = (F.size(stack) > 0) & (top != "..")
        keep = F.concat(stack, F.array(part))
        up = F.when(can_pop, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).when(absolute, stack).otherwise(keep)
        return F.when(part == "..", up).otherwise(keep)

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(joined)


def normalize_candidate(path: Column | str) -> Column:
    """The form that patterns are matched against: no empty segments, no leading ``/``."""
    flat = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(flat, "/+", "/"), "^/|/$", "")


def filename(path: Column | str) -> Column:
    return F.regexp_extract(normalize_candidate(path), "[^/]*$", 0)


def folder(path: Column | str) -> Column:
    """The path without its last segment; ``.`` where there is none."""
    p = normalize_candidate(path)
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit("."))


def type_name(name: Column | str) -> Column:
    """The last non-empty piece between ``/``, ``:`` and ``.``."""
    return F.regexp_extract(_col(name), r"([^/:.]+)[/:.]*$", 1)


def stem(path: Column | str) -> Column:
    name = filename(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def extension(path: Column | str) -> Column:
    """With its dot; empty where there is none."""
    return F.regexp_extract(filename(path), r"^.+(\.[^.]*)$", 1)


def crate_name(name: Column | str) -> Column:
    return F.replace(_col(name), F.lit("-"), F.lit("_"))


def non_blank_lines(content: Column | str) -> Column:
    return F.size(F.filter(F.split(_col(content), "\n", -1), lambda line: F.regexp_replace(line, r"\s+", "") != "")).cast("bigint")


def edge_text(source: Column, target: Column, external: Column, kinds: Column) -> Column:
    """``a -> b (external) [k1, k2]``, or ``a -> itself``."""
    listed = F.when(F.size(kinds) > 0, F.concat(F.lit(" ["), F.array_join(kinds, ", "), F.lit("]"))).otherwise(F.lit(""))
    text = F.concat(source, F.lit(" -> "), target, F.when(external, F.lit(" (external)")).otherwise(F.lit("")), listed)
    return F.when(source == target, F.concat(source, F.lit(" -> itself"))).otherwise(text)


def utc_stamp(seconds: Column | str) -> Column:
    """Seconds since 1970 as ``2024-02-29T23:59:59Z``, whatever the session's time zone.

    Years have four digits at least and no plus sign beyond 9999; negative years are not padded."""
    s = _col(seconds).cast("bigint")
    second = F.pmod(s, F.lit(86_400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((s - second) / 86_400).cast("int"))
    year = F.when(F.year(day) < 0, F.year(day).cast("string")).otherwise(F.format_string("%04d", F.year(day)))
    return F.when(s.isNotNull(), F.format_string("%s-%02d-%02dT%02d:%02d:%02dZ", year, F.month(day), F.dayofmonth(day), F.floor(second / 3_600), F.floor(second % 3_600 / 60), second % 60))
