"""Column expressions over raw HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import as_col, contains_any, emails_in, or_empty, strip

_ATTR = (
    rf'[{fv.SPACE}]([{fv.WORD}][{fv.WORD}-]*)'
    rf'(?:[{fv.SPACE}]*=[{fv.SPACE}]*(?:"([^"]*)"|\'([^\']*)\'|([^{fv.SPACE}]+)))?'
)
# Opening tags that hold more than a name; a bare "<p>" stays as it is anyway.
_OPEN_TAG = rf"<[{fv.WORD}]++[^>]+>"


def compress_attributes(html: Column) -> Column:
    """Keep only the known attributes of every opening tag, values quoted."""

    def keep(attr: Column) -> Column:
        name = F.regexp_extract(attr, rf"^.([{fv.WORD}-]+)", 1)
        return F.lower(name).isin(*fv.KEPT_ATTRIBUTES)

    def quoted(attr: Column) -> Column:
        full = F.regexp_replace(attr, rf"(?s)\A{_ATTR}\z", ' $1="$2$3$4"')
        return F.regexp_replace(full, rf'\A( [{fv.WORD}-]+)=""\z', "$1")

    def rebuilt(tag: Column) -> Column:
        attrs = F.filter(F.regexp_extract_all(tag, F.lit(_ATTR), 0), keep)
        head = F.regexp_extract(tag, rf"\A<[{fv.WORD}]+", 0)
        return F.concat(head, F.array_join(F.transform(attrs, quoted), ""), F.lit(">"))

    tags = F.transform(F.regexp_extract_all(html, F.lit(_OPEN_TAG), 0), rebuilt)
    between = F.split(html, _OPEN_TAG, -1)
    pieces = F.zip_with(
        between, tags, lambda text, tag: F.concat(text, F.coalesce(tag, F.lit("")))
    )
    return F.array_join(pieces, "")


def clean(html: Column | str) -> Column:
    """Drop noise elements, comments, unknown attributes and blank lines."""
    h = F.regexp_replace(as_col(html), r"(?s)<!--.*?-->", "")
    elements, tags = "|".join(fv.NOISE_ELEMENTS), "|".join(fv.NOISE_TAGS)
    h = F.regexp_replace(h, rf"(?is)<({elements})[^>]*>.*?</\1>", "")
    h = F.regexp_replace(h, rf"(?i)<(?:{tags})[^>]*>", "")
    h = compress_attributes(h)
    h = F.regexp_replace(h, rf"[{fv.SPACE}]{{3,}}", " ")
    lines = F.filter(F.split(h, fv.LINE_BREAK, -1), lambda line: strip(line) != "")
    return F.array_join(lines, "\n")


def visible_text(html: Column | str) -> Column:
    return F.regexp_replace(as_col(html), r"<[^>]+>", " ")


def _head(html: Column, chars: int | None) -> Column:
    return html if chars is None else F.substring(html, 1, chars)


def _without(html: Column, elements: tuple[str, ...]) -> Column:
    for name in elements:
        html = F.regexp_replace(html, rf"(?is)<{name}(?:[ \t\n\f\r][^>]*)?>.*?</{name}>", " ")
    return html


def _first(html: Column, element: str) -> Column:
    """Text of the first element of a name, tags in it included; empty if there is none."""
    return F.regexp_extract(html, rf"(?is)<{element}(?:[ \t\n\f\r][^>]*)?>(.*?)</{element}>", 1)


def has_content(html: Column | str, min_chars: int = fv.CONTENT_MIN_CHARS) -> Column:
    """Whether the visible text has more than ``min_chars`` characters."""
    return F.length(strip(visible_text(html))) > min_chars


def is_template(
    html: Column | str, head_chars: int | None = None, min_chars: int = fv.TEMPLATE_MIN_CHARS
) -> Column:
    """Pages whose records are filled in by scripts and so need rendering.

    Framework markers and data scripts are looked for in the whole page, markers not
    in code that it shows; with ``head_chars`` everywhere in so many first characters.
    Only pages of more than ``min_chars`` can be
    templates for mentioning staff without listing any.
    """
    html = as_col(html)
    head = _head(html, head_chars)
    framework = contains_any(head, fv.TEMPLATE_MARKERS)
    if head_chars is None:  # few pages have a marker at all
        framework = framework & contains_any(_without(html, fv.CODE_ELEMENTS), fv.TEMPLATE_MARKERS)
    scripts = F.regexp_extract_all(head, F.lit(r"(?is)<script[^>]*>.*?</script>"), 0)
    data_script = F.exists(scripts, lambda s: contains_any(F.lower(s), fv.DATA_API_MARKERS))
    # cheap tests first: the rest is only evaluated for long pages
    person = fv.TITLE_PREFIX_PATTERN
    staff_without_rows = (
        (F.length(html) > min_chars)
        & contains_any(F.lower(visible_text(html)), fv.STAFF_WORDS)
        & (F.size(emails_in(html)) < fv.TEMPLATE_MIN_EMAILS)
        & ~html.rlike(rf"(?is)<li[^>]*>[{fv.SPACE}]*{person}[{fv.SPACE}]*[A-Z]")
        & ~html.rlike(
            rf"(?is)<table[^>]*>.*?<t[rd][^>]*>[{fv.SPACE}]*{person}[{fv.SPACE}]+[A-Z].*?</table>"
        )
    )
    return framework | data_script | staff_without_rows


def is_blocked(
    html: Column | str,
    head_chars: int | None = None,
    min_chars: int = fv.BLOCKED_MIN_CHARS,
    max_words: int = fv.BLOCKED_MAX_WORDS,
) -> Column:
    """Missing, refused or challenge pages and those under ``min_chars``; never NULL.

    Pages are read whole. What they are called says whether they were refused: the title, the
    first heading, and all visible text of a page of up to ``max_words`` words. A longer
    page may have 403 in a phone number or write of what is forbidden. With
    ``head_chars`` the signs count wherever they are in so many first characters.
    """
    html = as_col(html)
    if head_chars is not None:
        head = _head(html, head_chars)
        refused = head.rlike(fv.BLOCKED_HEAD_PATTERN) | head.contains(fv.BLOCKED_MARKER)
    else:
        # the words are only counted in pages that have a sign somewhere
        text = visible_text(_without(html, fv.SCRIPT_ELEMENTS))
        short = F.regexp_count(text, F.lit(r"[^ \t\n\f\r]+")) <= max_words
        names = F.concat(_first(html, "title"), F.lit(" "), _first(html, "h1"))
        said = names.rlike(fv.BLOCKED_HEAD_PATTERN) | (short & text.rlike(fv.BLOCKED_HEAD_PATTERN))
        refused = (html.rlike(fv.BLOCKED_HEAD_PATTERN) & said) | html.contains(fv.BLOCKED_MARKER)
    return F.coalesce((F.length(html) < min_chars) | refused, F.lit(True))


def is_blocked_render(
    html: Column | str,
    title: Column | str,
    head_chars: int | None = None,
    min_chars: int = fv.BLOCKED_MIN_CHARS,
) -> Column:
    """The same test for rendered pages, which know their title."""
    html, title = as_col(html), or_empty(title)
    return F.coalesce(
        (F.length(html) < min_chars)
        | contains_any(title, fv.BLOCKED_TITLE_TEXTS)
        | _head(html, head_chars).contains(fv.BLOCKED_MARKER),
        F.lit(True),
    )


def hrefs(html: Column | str) -> Column:
    return F.regexp_extract_all(
        as_col(html), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"[^>]*>'), 1
    )


def listing_blocks(html: Column | str) -> Column:
    """List items and table rows of a page, in page order."""
    return F.regexp_extract_all(
        as_col(html), F.lit(r"(?is)<(li|tr)(?:\s[^>]*)?>(.*?)</\1>"), 2
    )
