"""How keys are compared: split names, group ids, hashes, segment ids and paths.

Every function takes and returns a Column, stays inside whole-stage code generation and gives null for null.
A key that is blank after trimming is null: it refers to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b "
#: First steps at which a stored path begins.
PATH_ROOTS = ("segments", "features", "raw")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def filled(c: Column) -> Column:
    """Null instead of an empty text.

    The argument is named once, where a condition would work it out twice. ``nullif`` does that too, but numbers its
    argument anew in each branch of a plan, and equal branches are then no longer recognised and shared.
    """
    return F.get(F.array_remove(F.array(c), F.lit("")), F.lit(0))


def split_name(c: Column | str) -> Column:
    """train, validation or test by the first three letters; null for anything else."""
    head = F.substring(F.lower(strip(c)), 1, 3)
    return F.when(head == "tra", "train").when(head == "val", "validation").when(head == "tes", "test")


def group_key(c: Column | str) -> Column:
    return filled(F.lower(strip(c)))


def source_key(c: Column | str) -> Column:
    return filled(F.replace(F.lower(strip(c)), F.lit("-"), F.lit("_")))


def sha_key(c: Column | str) -> Column:
    return filled(F.btrim(F.regexp_replace(F.lower(strip(c)), "^sha256:", ""), F.lit(BLANKS)))


def _segment_text(c: Column | str) -> Column:
    return F.replace(F.lower(strip(c)), F.lit("_"), F.lit(":"))


def segment_key(c: Column | str) -> Column:
    """``<sha256>:<index>`` in lower case, ``_`` read as ``:``, the index without leading zeros."""
    return filled(F.regexp_replace(_segment_text(c), ":0+([0-9]+)$", ":$1"))


def segment_sha(c: Column | str) -> Column:
    """The sha256 of a segment id; null where the id is not ``<sha256>:<index>``."""
    return filled(F.regexp_extract(_segment_text(c), "^(.+):[0-9]{1,9}$", 1))


def segment_index(c: Column | str) -> Column:
    return F.regexp_extract(_segment_text(c), ":([0-9]{1,9})$", 1).try_cast("int")


def path_key(c: Column | str) -> Column:
    """A path with ``/`` steps, without empty and ``.`` steps, from its first known root on."""
    roots = "|".join(PATH_ROOTS)
    rooted = F.concat(F.lit("/"), F.replace(strip(c), F.lit("\\"), F.lit("/")))
    steps = F.regexp_replace(rooted, "(?:/\\.?)+(?=/|$)", "")
    return filled(F.substring(F.regexp_replace(steps, f"(?s)^.*?(?=/(?:{roots})(?:/|$))", ""), 2, 1 << 30))
