"""Fill-in-middle texts, cut at boundaries that a learned index of ranks finds.

A text is cut into units, its lines. The index of a text answers "at which code point does
unit k end" without the text: the offsets of all boundaries are a rising function of their
rank, covered by straight segments whose error is at most ``ERROR`` code points, and for
each boundary what the rounded segment is off by is stored in as few bytes as the
largest of a text needs. A cut is predicted from the segment of its rank and corrected by the
stored residual, so it is exact for every boundary.

The index is fitted in one pass over the text (greedily: a segment goes on while a slope within
the error of all its points exists). Everything after it, from the lookup to
the transformed text, is expressions: of two ranks drawn by a hash of doc_id, the text up
to the smaller is the prefix, up to the greater the middle, the rest the suffix.

* Null and empty texts are empty: no units, plain form. A text with a sentinel stays plain.
* Null doc_ids draw as the text ``null``. Repeated rows are transformed alike, each for itself.
* Texts of any length are indexed whole; an empty table gives an empty result.
* Extra columns pass through; helper columns avoid their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.columns import unused, whole_text
from rosterlake.llm.wordhash import STEP_BYTES

#: Code points by which a segment may miss a boundary.
ERROR = 64
#: Points that the fit looks at first for a segment; doubled while they fit.
FIRST_LOOK = 128

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of 100 texts, those that are transformed, and of these those with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 100, 50

SEGMENT = "struct<first:long,offset:long,slope:double>"
INDEX = f"units long, segments array<{SEGMENT}>, width int, least long, residuals binary"
ARROW_INDEX = [
    ("units", pa.int64()),
    ("segments", pa.list_(pa.struct([("first", pa.int64()), ("offset", pa.int64()), ("slope", pa.float64())]))),
    ("width", pa.int32()),
    ("least", pa.int64()),
    ("residuals", pa.binary()),
]


def segments(offsets: np.ndarray, error: int) -> list[tuple[int, int, float]]:
    """First rank, its offset and the slope of segments that miss no offset by more than ``error``."""
    out, at, last = [], 0, len(offsets) - 1
    while at <= last:
        low, high, end, look = -np.inf, np.inf, at, FIRST_LOOK
        while end < last:
            k = np.arange(end + 1, min(end + look, last) + 1)
            rise, run = offsets[k] - offsets[at], k - at
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            fits = int(np.searchsorted(lows > highs, True))  # both are monotone
            if fits:
                low, high, end = lows[fits - 1], highs[fits - 1], end + fits
            if fits < len(k):
                break
            look *= 2
        out.append((at, int(offsets[at]), float((low + high) / 2) if end > at else 0.0))
        at = end + 1
    return out


def fit(offsets: np.ndarray, error: int = ERROR) -> dict:
    """The index of rising offsets: segments, and the residuals in ``width`` bytes each."""
    found = segments(offsets, error)
    first, start, slope = (np.array(c) for c in zip(*found, strict=True))
    of = np.repeat(np.arange(len(found)), np.diff(np.append(first, len(offsets))))
    ranks = np.arange(len(offsets)) - first[of]
    off_by = offsets - start[of] - np.floor(slope[of] * ranks).astype(np.int64)
    least = int(off_by.min())
    width = max(1, (int(off_by.max() - least).bit_length() + 7) // 8)
    raw = (off_by - least).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    names = ("first", "offset", "slope")
    return {
        "units": len(offsets) - 1,
        "segments": [dict(zip(names, s, strict=True)) for s in found],
        "width": width,
        "least": least,
        "residuals": raw.tobytes(),
    }


def line_ends(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Of each text 0 and the number of code points up to the end of each line."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    code_points = np.zeros(len(joined) + 1, np.int64)
    np.cumsum((joined & 0xC0) != 0x80, out=code_points[1:])
    breaks = np.flatnonzero(joined == 0x0A) + 1
    at = 0
    for text in texts:
        start, at = at, at + len(text)
        ends = breaks[np.searchsorted(breaks, start, "right") : np.searchsorted(breaks, at, "right")]
        if len(text) and not text.endswith(b"\n"):
            ends = np.append(ends, at)
        yield code_points[np.append(start, ends)] - code_points[start]


def _runs(texts: pa.Array) -> Iterator[list[bytes]]:
    run: list[bytes] = []
    size = 0
    for text in texts.cast(pa.large_binary()):
        raw = text.as_py() or b""
        if run and size + len(raw) > STEP_BYTES:
            yield run
            run, size = [], 0
        run.append(raw)
        size += len(raw)
    if run:
        yield run


def rank_index(text: Column, error: int = ERROR) -> Column:
    """The index of the line ends of a text, as a struct column."""

    @F.arrow_udf(INDEX)
    def index(texts: pa.Array) -> pa.Array:
        rows = [fit(ends, error) for run in _runs(texts) for ends in line_ends(run)]
        return pa.array(rows, pa.struct(ARROW_INDEX))

    return index(text)


def offset_at(index: Column, rank: Column) -> Column:
    """The offset of a boundary: predicted by the segment of its rank, then corrected."""
    segment = F.element_at(F.filter(index["segments"], lambda s: s["first"] <= rank), -1)
    predicted = segment["offset"] + F.floor(segment["slope"] * (rank - segment["first"]))
    place = (rank * index["width"] + 1).cast("int")
    stored = F.conv(F.hex(F.substring(index["residuals"], place, index["width"])), 16, 10).cast("long")
    return predicted + stored + index["least"]


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the sha256 of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    seed: int = SEED,
    transformed: int = TRANSFORMED,
    suffix_first: int = SUFFIX_FIRST,
    error: int = ERROR,
    name: str = "fim",
) -> DataFrame:
    """``docs`` with a struct column ``name``: n (units), form, prefix_chars, middle_chars, output."""
    whole = whole_text(text)
    at = unused(docs, "_index")
    docs = docs.withColumn(at, rank_index(whole, error))
    index, (one, two, form_draw, order_draw) = F.col(at), draws(F.col(doc_id), seed)
    ranks = [F.pmod(h, index["units"] + 1) for h in (one, two)]
    start, end = (offset_at(index, f(*ranks)) for f in (F.least, F.greatest))
    plain = (whole == "") | (form_draw % 100 >= transformed)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | whole.contains(sentinel)
    spm = order_draw % 100 < suffix_first
    form = F.when(plain, "plain").when(spm, "spm").otherwise("psm")
    docs = docs.withColumn(
        at,
        F.struct(
            index["units"].alias("n"),
            form.alias("form"),
            F.when(~plain, start).alias("prefix_chars"),
            F.when(~plain, end - start).alias("middle_chars"),
        ),
    )
    cut = F.col(at)
    first, middle = cut["prefix_chars"].cast("int"), cut["middle_chars"].cast("int")
    prefix = F.concat(F.lit(PREFIX), F.substring(whole, F.lit(1), first))
    suffix = F.concat(F.lit(SUFFIX), F.substring(whole, first + middle + 1, F.length(whole)))
    middle = F.concat(F.lit(MIDDLE), F.substring(whole, first + 1, middle))
    output = (
        F.when(cut["form"] == "plain", whole)
        .when(cut["form"] == "spm", F.concat(suffix, prefix, middle))
        .otherwise(F.concat(prefix, suffix, middle))
    )
    return docs.withColumn(name, cut.withField("output", output)).drop(at)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
        .when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
    )
