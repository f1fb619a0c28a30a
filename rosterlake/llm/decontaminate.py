"""Finding and removing benchmark passages in training documents.

The normalised word windows of the benchmark go to all executors as a hash
set; a scan of the documents looks every window of theirs up in it, compares the
words of each hit, and marks the words that lie in hits. No shuffle, whole texts.

A broadcast set has a proven size: the benchmark's bytes are counted first, and
a benchmark of more than ``broadcast_bytes`` is cut by a hash of the item id
into slices below that. A slice of that size is held in up to 15 times its bytes, of words of one
letter, and 6 times, of common words. The scan then runs once per slice, each adding
its hits to those before in the same row, so the result is the same.

Words are runs of digits, letters and characters beyond ASCII after lowering A-Z.
An item of fewer words than a window is one window; one without words has none.

* Null and empty texts have no words, no hits, and are never contaminated.
* Null item ids count as the text ``null``; items repeated word by word all match.
* Repeated document rows are judged one by one; an empty benchmark hits nothing.
* Extra columns pass through; names that clash are avoided for helper columns.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.columns import unused
from rosterlake.llm.wordhash import ALNUM, Words, steps

WINDOW_WORDS = 13
#: Of a slice of the benchmark that is held in memory by driver and workers.
BROADCAST_BYTES = 16 << 20
#: A document counts as contaminated from this part of its words on.
CONTAMINATED_PART = (1, 20)

HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, marks binary"


class WindowSet:
    """Windows of benchmark items by length, packed into arrays.

    The words of all items stand in one buffer, a space between two. A window is
    the hash of its words, its place there and its item: 28 bytes a window beside the
    text, whatever the number of windows.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.names = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.names)}
        found: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        texts, origin = [], 0
        for item, text in items:
            for run in steps([text]):
                words = Words(run, ALNUM, lower=True)
                n = min(window, len(words.hash))
                if not n:
                    continue
                # words end where the next one starts, but for a space
                lengths = words.end - words.start
                start = origin + np.concatenate(([0], np.cumsum(lengths + 1)))
                at, hashes = words.windows(n)
                owner = np.full(len(at), number[item], np.int32)
                found[n].append((hashes, start[at], start[at + n] - 1, owner))
                texts.append(b" ".join(words.text(i) for i in range(len(lengths))) + b" ")
                origin = int(start[-1])
        self.text = b"".join(texts)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for n, parts in found.items():
            hashes, start, end, owner = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            # a window repeated by an item counts once, unless it may be another with its hash
            start, end = start[order], end[order]
            again = np.zeros(len(order), bool)
            twin = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])) + 1
            for i in twin.tolist():
                again[i] = self.text[start[i] : end[i]] == self.text[start[i - 1] : end[i - 1]]
            self.by_length[n] = (hashes[~again], start[~again], end[~again], owner[~again])

    @property
    def n_bytes(self) -> int:
        """What the set holds, but for the item ids."""
        return len(self.text) + sum(a.nbytes for arrays in self.by_length.values() for a in arrays)

    def hits(self, words: Words) -> Iterator[tuple[int, int, set[str]]]:
        """First word, number of words and items of each window found."""
        for n, (known, start, end, owner) in self.by_length.items():
            at, hashes = words.windows(n)
            low = np.searchsorted(known, hashes)
            for i in np.flatnonzero(known[np.minimum(low, len(known) - 1)] == hashes):
                first = int(at[i])
                own = b" ".join(words.text(k) for k in range(first, first + n))
                items = set()
                j = int(low[i])
                while j < len(known) and known[j] == hashes[i]:
                    if self.text[start[j] : end[j]] == own:
                        items.add(self.names[owner[j]])
                    j += 1
                if items:
                    yield first, n, items


def _scanner(windows):
    """A column function: texts and earlier hits to hits."""

    @F.pandas_udf(HITS)
    def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: WindowSet = windows.value
        for texts, earlier_marks, earlier_items in batches:
            rows = []
            for run in steps(texts):
                words = Words(run, ALNUM, lower=True)
                hit = np.zeros(len(words.hash), bool)
                items: dict[int, set[str]] = defaultdict(set)
                for first, n, names in known.hits(words):
                    hit[first : first + n] = True
                    items[int(words.doc[first])] |= names
                origin = 0
                for d, raw in enumerate(run):
                    a, b = words.first[d], words.first[d + 1]
                    own, names = hit[a:b], items.get(d, set())
                    marks = earlier_marks.iloc[len(rows)]
                    if isinstance(marks, bytes | bytearray):
                        own = own | np.unpackbits(np.frombuffer(marks, np.uint8), count=b - a).astype(bool)
                        names = names | set(earlier_items.iloc[len(rows)])
                    spans = []
                    if own.any():
                        edge = np.diff(np.concatenate(([0], own.astype(np.int8), [0])))
                        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                        spans = [
                            {"start": int(words.start[a + s]) - origin, "end": int(words.end[a + e - 1]) - origin}
                            for s, e in zip(starts, ends, strict=True)
                        ]
                    packed = np.packbits(own).tobytes() if own.any() else None
                    rows.append((int(b - a), int(own.sum()), sorted(names), spans, packed))
                    origin += len(raw) + 1
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans", "marks"])

    return scan


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    broadcast_bytes: int = BROADCAST_BYTES,
    name: str = "contamination",
) -> DataFrame:
    """``docs`` with a struct column ``name`` (one of that name is replaced): n_words, n_hit, items (sorted ids
    of the items with windows in the text), spans (byte ranges of hit words in
    the UTF-8 text), marks (a bit per word, null without hits)."""
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t")
    )
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    slices = max(1, math.ceil(size / broadcast_bytes))
    out = docs.withColumn(
        name, F.lit(None).cast("struct<marks:binary,items:array<string>>")
    )
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k)
        known = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in part.collect()], window))
        out = out.withColumn(name, _scanner(known)(F.col(text), F.col(name)["marks"], F.col(name)["items"]))
    return out


def contaminated(name: str = "contamination", part: tuple[int, int] = CONTAMINATED_PART):
    """Whether hit words make at least ``part`` of the words."""
    hits = F.col(name)
    return (hits["n_hit"] > 0) & (hits["n_hit"] * part[1] >= hits["n_words"] * part[0])


def items_digest(name: str = "contamination"):
    return F.sha2(F.array_join(F.col(name)["items"], ","), 256)


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that aren't contaminated, with the columns they have."""
    name = unused(docs, "_contamination")
    marked = find_contamination(docs, benchmark, text, name=name, **options)
    return marked.where(~contaminated(name)).drop(name)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents, without the hit words; what stood around them stays."""
    name = unused(docs, "_contamination")
    marked = find_contamination(docs, benchmark, text, name=name, **options)

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        kept = []
        for raw, cuts in zip(texts, spans, strict=True):
            if raw is None or len(cuts) == 0:
                kept.append(raw)
                continue
            data, at, parts = raw.encode(), 0, []
            for cut in cuts:
                parts.append(data[at : cut["start"]])
                at = cut["end"]
            kept.append(b"".join([*parts, data[at:]]).decode())
        return pd.Series(kept, dtype=object)

    return marked.withColumn(text, without(F.col(text), F.col(name)["spans"])).drop(name)


def empty_digest() -> str:
    """The digest of a document without items."""
    return hashlib.sha256(b"").hexdigest()
