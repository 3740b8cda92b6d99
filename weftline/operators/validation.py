"""Row validation as ordered column expressions, and partial updates with presence flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a strip takes off both ends.
BLANK = r"^[\s]+|[\s]+$"


def stripped(text: Column) -> Column:
    """ST1: the text without white space at its ends."""
    return F.regexp_replace(text, BLANK, "")


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """PF4: message of the first rule that fails, null if none does. A rule that is null counts as failed."""
    out = None
    for ok, message in rules:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, F.lit(message)) if out is None else out.when(bad, F.lit(message))
    return out if out is not None else F.lit(None).cast("string")


def all_failures(rules: list[tuple[Column, str]], sep: str = ", ") -> Column:
    """PF5: messages of all rules that fail, joined; null if none does."""
    found = F.concat_ws(sep, *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in rules])
    return F.when(found != "", found)


def unknown_fields(keys: Column, allowed: list[str]) -> Column:
    """PF6: the fields of a batch update that are not allowed, sorted and joined; null if all are."""
    bad = F.array_join(F.array_sort(F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))), ", ")
    return F.when(bad != "", bad)


def overlay(current: Column, present: Column, patch: Column) -> Column:
    """PF9: the patch where it is present (a present null deletes), otherwise what was there."""
    return F.when(present, patch).otherwise(current)


def precondition(sent: Column, etag: Column, reading: bool) -> Column:
    """PF19: 428 without a tag, 412 if it differs; a read with an equal tag is 304, a write passes with 200."""
    if reading:
        return F.when(sent == etag, F.lit(304)).otherwise(F.lit(200))
    return F.when(sent.isNull(), F.lit(428)).when(sent != etag, F.lit(412)).otherwise(F.lit(200))
