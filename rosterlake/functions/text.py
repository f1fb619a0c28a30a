"""Column helpers for strings. NULL and "" are different values throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnOrName) -> Column:
    """Drop leading and trailing whitespace, Unicode spaces included."""
    return F.btrim(as_col(c), F.lit(fv.SPACE_CHARS))


def is_blank(c: ColumnOrName) -> Column:
    """True for NULL, empty and whitespace-only values; never NULL itself."""
    return F.coalesce(strip(c), F.lit("")) == ""


def null_if_blank(c: ColumnOrName) -> Column:
    """NULL when blank, otherwise the value as it is (not stripped)."""
    c = as_col(c)
    return F.when(~is_blank(c), c)


def null_if_token(c: ColumnOrName) -> Column:
    """Stripped value, with the spelled-out nulls mapped to NULL."""
    s = strip(c)
    return F.when(~F.lower(s).isin(*fv.NULL_TOKENS), s)


def or_empty(c: ColumnOrName) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def contains_any(c: ColumnOrName, texts) -> Column:
    c = as_col(c)
    return reduce(lambda a, b: a | b, (c.contains(t) for t in texts))


def word_list_pattern(words) -> str:
    """Case-insensitive pattern for whole words or phrases, plural allowed."""
    return r"(?i)(?:^|[^a-z])(?:" + "|".join(words) + r")s?(?:$|[^a-z])"


def emails_in(c: ColumnOrName) -> Column:
    """Distinct email addresses in order of first appearance."""
    c = as_col(c)
    none = F.array().cast("array<string>")
    return F.when(
        c.contains("@"),
        F.array_distinct(F.regexp_extract_all(c, F.lit(fv.EMAIL_PATTERN), 0)),
    ).otherwise(none)


def deobfuscate_emails(c: ColumnOrName) -> Column:
    """Turn ``a [at] b`` and ``a[@]b`` into ``a@b`` and drop ``mailto:``."""
    c = as_col(c)
    space = f"[{fv.SPACE}]*"
    plain = F.regexp_replace(c, rf"(?i){space}\[{space}(?:@|at){space}\]{space}", "@")
    c = F.when(c.contains("["), plain).otherwise(c)
    return F.regexp_replace(c, "(?i)mailto:", "")


def url_in(c: ColumnOrName) -> Column:
    """First URL in free text without closing dots and brackets, else NULL."""
    found = F.regexp_extract(as_col(c), fv.URL_PATTERN, 0)
    return F.when(found != "", F.regexp_replace(found, r"[.)]+\z", ""))


def title_prefix(c: ColumnOrName) -> Column:
    found = F.regexp_extract(strip(c), fv.HONORIFIC_PATTERN, 1)
    return F.when(found != "", found)


def has_included_role(c: ColumnOrName) -> Column:
    """Teaching and research roles; an excluded role wins, NULL is not a role.

    What follows "of", "in" or "for" after an included role is its field, which
    excludes nothing: a professor of finance is no finance officer.
    """
    c = or_empty(c)
    roles = "|".join(fv.ROLE_INCLUDE)
    own = F.regexp_replace(c, rf"(?is)((?:^|[^a-z])(?:{roles})s?,?)\s+(?:of|in|for)[^a-z].*", "$1")
    return c.rlike(word_list_pattern(fv.ROLE_INCLUDE)) & ~own.rlike(
        word_list_pattern((*fv.ROLE_EXCLUDE, "postdoctoral"))
    )


def is_academic_department(c: ColumnOrName) -> Column:
    return ~is_blank(c) & ~or_empty(c).rlike(word_list_pattern(fv.DEPARTMENT_EXCLUDE))


def add_remark(remark: ColumnOrName, message: ColumnOrName) -> Column:
    """Append a message with "; "; either side may be NULL or empty."""
    return F.nullif(
        F.concat_ws(
            "; ", F.nullif(as_col(remark), F.lit("")), F.nullif(as_col(message), F.lit(""))
        ),
        F.lit(""),
    )


def snake(c: ColumnOrName) -> Column:
    return F.replace(F.lower(as_col(c)), F.lit(" "), F.lit("_"))
