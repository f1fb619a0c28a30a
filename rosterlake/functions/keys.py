"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, or_empty

SOURCE_KEY = "_source_key"
_FIELD_SEP = "\u001f"


def source_key(university: Column | str, department: Column | str) -> Column:
    return F.concat(or_empty(department), F.lit("/"), or_empty(university))


def _digest(text: Column, chars: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, chars)


def job_id(university: Column | str, department: Column | str) -> Column:
    return _digest(F.concat(as_col(university), F.lit("::"), or_empty(department)), 32)


def url_key(url: Column | str) -> Column:
    return _digest(as_col(url), 40)


def record_id(
    university: Column | str,
    department: Column | str,
    keys: dict[str, Column],
    content: Column | None = None,
) -> Column:
    """Id of a record from its non-empty key values, by key name.

    Rows without any key value would share one id; ``content`` is used for them
    in place of the keys.
    """
    named = [
        F.when(or_empty(v) != "", F.concat(F.lit(name + "="), v))
        for name, v in sorted(keys.items())
    ]
    joined = F.concat_ws(_FIELD_SEP, *named)
    if content is not None:
        joined = F.when(joined == "", F.concat(F.lit("content="), content)).otherwise(joined)
    return _digest(
        F.concat(
            as_col(university), F.lit(_FIELD_SEP), or_empty(department), F.lit(_FIELD_SEP), joined
        ),
        32,
    )
