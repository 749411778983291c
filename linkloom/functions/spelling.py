"""Spellings of paths, anchors and sequence numbers, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_key(path: Column) -> Column:
    """One spelling per file: letter case, kind and number of slashes, a leading slash, ``.`` and ``x/..`` steps and outer
    white space don't count. Null, blank and pure ``.`` paths give null; a leading ``..`` that has nothing to undo stays.
    """
    low = F.trim(F.lower(path))
    # most paths are plain: cheap searches spare them the patterns
    odd = F.lit(False)
    for sign in ("\\", "//", "./", "\t", "\n", "\r", "\u00a0"):
        odd = odd | F.contains(low, F.lit(sign))
    for sign in ("/", "."):
        odd = odd | F.startswith(low, F.lit(sign)) | F.endswith(low, F.lit(sign))
    flat = F.regexp_replace(F.regexp_replace(low, r"^[\s\x{a0}]+|[\s\x{a0}]+$", ""), r"[/\\]+", "/")
    steps = F.filter(F.split(flat, "/"), lambda s: (s != "") & (s != "."))
    undone = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.nullif(F.when(odd, F.array_join(undone, "/")).otherwise(low), F.lit(""))


def anchor_key(anchor: Column) -> Column:
    """One spelling per anchor: letter case, white space and ``#`` don't count; null and blank give null."""
    low = F.lower(anchor)
    odd = F.contains(low, F.lit("#")) | F.contains(low, F.lit(" ")) | F.contains(low, F.lit("\u00a0")) | F.contains(low, F.lit("\t")) | F.contains(low, F.lit("\n"))
    return F.nullif(F.when(odd, F.regexp_replace(low, r"[\s\x{a0}#]+", "")).otherwise(low), F.lit(""))


def sequence_key(number: Column) -> Column:
    """The number at the end of a sequence notation as (at least) four digits; null and notations without one give 0000."""
    tail = F.regexp_extract(number, r"([0-9]+)[\s\x{a0}]*$", 1)
    digits = F.regexp_replace(F.coalesce(tail, F.lit("")), "^0+", "")
    return F.when(F.length(digits) > 4, digits).otherwise(F.lpad(digits, 4, "0"))


def squeezed(text: Column) -> Column:
    """Text without any white space, in lower case; null stays null."""
    return F.regexp_replace(F.lower(text), r"[\s\x{a0}]+", "")
