"""Column functions over specification ids, file stems and record identities (PRJ-01 to PRJ-09, PRJ-17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(spec: Column) -> Column:
    return F.split(spec, "-")


def suite_of(spec: Column) -> Column:
    """PRJ-01: what stands before the first '-'; null gives 'unknown'."""
    return F.coalesce(F.substring_index(spec, "-", 1), F.lit("unknown"))


def kernel_of(spec: Column) -> Column:
    """PRJ-02: the middle segments; an id of fewer than three segments stays whole, null gives 'unknown'."""
    p = _parts(spec)
    middle = F.array_join(F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(1))), "-")
    return F.coalesce(F.when(F.size(p) < 3, spec).otherwise(middle), F.lit("unknown"))


def api_of(spec: Column) -> Column:
    """PRJ-03: what stands after the last '-'."""
    return F.coalesce(F.substring_index(spec, "-", -1), F.lit("unknown"))


def direction_of(stored: Column, source: Column, target: Column) -> Column:
    """PRJ-04: the stored direction if there is one, else it follows from the two ids; an empty id gives 'unknown'."""
    derived = F.when((F.coalesce(source, F.lit("")) == "") | (F.coalesce(target, F.lit("")) == ""), "unknown").otherwise(F.concat(api_of(source), F.lit("-to-"), api_of(target)))
    return F.coalesce(F.nullif(stored, F.lit("")), derived)


def level_of_stem(stem: Column) -> Column:
    """PRJ-05: the N of a file stem that ends with -LN or -LN-sM, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"-L(\d+)(?:-s\d+)?$", 1), F.lit("")).cast("int"), F.lit(0))


def sample_of_stem(stem: Column) -> Column:
    """PRJ-05: the M of a file stem that ends with -sM, else null."""
    return F.nullif(F.regexp_extract(stem, r"-s(\d+)$", 1), F.lit("")).cast("int")


def first_set(top: Column, parent: Column) -> Column:
    """PRJ-06: a text field of the record, or its parent's where it is null or empty."""
    return F.coalesce(F.nullif(top, F.lit("")), parent)


def record_key(model: Column, source: Column, target: Column, level: Column, sample: Column) -> Column:
    """PRJ-09: model|source|target|Ln|sn."""
    return F.concat_ws("|", model, source, target, F.concat(F.lit("L"), level), F.concat(F.lit("s"), sample))


def seed31(source: Column, target: Column, sample: Column) -> Column:
    """PRJ-17: 31 bits of the SHA-256 of the three, joined by '|'."""
    digest = F.substring(F.sha2(F.concat_ws("|", source, target, sample.cast("string")), 256), 1, 8)
    return F.conv(digest, 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
