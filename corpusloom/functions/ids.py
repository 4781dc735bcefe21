"""Ids, ordinals, stamps and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbered(prefix: str, n: Column) -> Column:
    """The prefix and a number of three digits at least, without a formatter for each row."""
    digits = n.cast("string")
    return F.concat(F.lit(prefix), F.when(n.between(0, 999), F.lpad(digits, 3, "0")).when(n > 999, digits).otherwise(F.format_string("%03d", n)))


def unit_id(doc: Column, sect: Column, para: Column, sent: Column | None = None, word: Column | None = None) -> Column:
    """doc_001.sec_001.p_001.s_001.w_001 from 0-based places, three digits at least."""
    parts = [numbered("doc_", doc + 1), numbered("sec_", sect + 1), numbered("p_", para + 1)]
    if sent is not None:
        parts.append(numbered("s_", sent + 1))
    if word is not None:
        parts.append(numbered("w_", word + 1))
    return F.concat_ws(".", *parts)


def next_child_index(ids: Column, kind: str) -> Column:
    """One more than the largest numeric suffix among siblings, as an aggregate; other suffixes don't count."""
    return F.coalesce(F.max(F.regexp_extract(ids, rf"(?:^|\.){kind}_(\d+)$", 1).try_cast("long")), F.lit(0)) + 1


def next_participant_id(ids: Column, prefix: str) -> Column:
    return F.format_string(f"{prefix}_%03d", F.coalesce(F.max(F.regexp_extract(ids, rf"^{prefix}_(\d+)$", 1).try_cast("int")), F.lit(0)) + 1)


def id_instant(c: Column) -> Column:
    """The epoch milliseconds that an id holds, if they lie between 2001 and 2100."""
    ms = F.regexp_extract(c, r"(?<!\d)(\d{13})(?!\d)", 1).try_cast("long")
    return F.when(ms.between(978_307_200_000, 4_102_444_800_000), ms)


def id_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))


def id_lte(a: Column, b: Column) -> Column:
    """Whether id a is at or before id b: digit groups as numbers, then the strings."""
    x, y = id_numbers(a), id_numbers(b)
    return F.when(x == y, a <= b).otherwise(x < y)


def dep_local_id(c: Column) -> Column:
    return F.element_at(F.split(F.coalesce(c, F.lit("")), r"\."), -1)


def dep_rel_of(head_present: Column, head: Column, rel: Column) -> Column:
    return F.when(head_present & head.isNull(), F.lit("root")).otherwise(rel)


def utc_offset_minutes(instant_ms: Column, date: Column, time: Column) -> Column:
    """Local wall clock less the instant, folded to half a day, to the nearest quarter of an hour."""
    local = F.unix_timestamp(F.to_timestamp(F.concat_ws(" ", date, time), "yyyy-MM-dd HH:mm:ss"))
    minutes = (local - F.floor(instant_ms / 1000)) / 60
    folded = F.pmod(minutes + 720, F.lit(1440)) - 720
    return (F.round(folded / 15) * 15).cast("int")


def corrected_date(date: Column, time: Column, offset_minutes: Column) -> Column:
    """A date stamped in UTC beside a local time, as the local date."""
    h = F.split(time, ":")
    at = h[0].cast("int") * 60 + h[1].cast("int")
    day = F.to_date(date)
    out = F.when((offset_minutes < 0) & (at >= 1440 + offset_minutes), F.date_sub(day, 1)).when((offset_minutes > 0) & (at < offset_minutes), F.date_add(day, 1)).otherwise(day)
    return F.date_format(out, "yyyy-MM-dd")


def stamp(annotator_id: Column, annotator: Column, date: Column, time: Column, derived: Column | None = None, origin: Column | None = None) -> Column:
    """A provenance moment; the clock is an argument, so results are reproducible."""
    return F.struct(annotator_id.alias("annotator_id"), annotator.alias("annotator"), date.alias("date"), time.alias("time"), (derived if derived is not None else F.lit(False)).alias("derived"), (origin if origin is not None else F.lit(None).cast("string")).alias("from"))
