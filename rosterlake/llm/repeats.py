"""Repeated byte strings across all documents, by range-partitioned suffixes.

A byte goes if a string of ``length`` bytes that covers it starts at another
place too, in any document. Only some suffixes need sorting: in every
string of that length one place is chosen by its content alone, the one with the
least hash of the next ``KEY_BYTES`` bytes. Equal strings choose equal
places, so two copies share a chosen suffix together with the bytes before it.

1. The scan lists the chosen suffixes (about one in 75 bytes) with a key: their
   leading four bytes, then a hash of their first ``KEY_BYTES`` bytes.
2. Keys that occur at two places stay; sampled splitters between keys form
   ranges, so suffixes with equal beginnings fall into one bucket.
3. Only those suffixes are cut out of the texts, each with the bytes before it, sent to
   their bucket and sorted there by multikey quicksort, forwards and backwards. Common
   prefixes of neighbours give, for each string length on either side, who
   agrees with whom: a place is repeated from r bytes before the suffix on if another
   agrees in r bytes before and ``length`` - r bytes after it.
4. A splitter never parts equal beginnings, so nothing is to be compared across
   it. A key of more than ``bucket_rows`` places doesn't fit a bucket: its equal
   surroundings are first counted, and only different ones sorted. If even those are
   too many, strings are compared across all tasks by their hashes, which spreads any key.

Texts are hashed to 64 bits; equal texts are sorted once and removed as a whole
where they have ``length`` bytes, so thousands of copies cost one. The list of
places, a large table, is made twice rather than written.

* Null texts are empty; texts shorter than ``length`` are never touched.
* Overlaps count, also of a text with itself. Removal is judged on the input.
* Repeated rows are copies of each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.columns import whole_text
from rosterlake.llm.wordhash import BYTE_VALUES, PrefixHash, U, steps
from rosterlake.session import StepTables

LENGTH = 200
#: Bytes of a suffix that its key depends on.
KEY_BYTES = 50
#: Places of one key that are compared in one task.
BUCKET_ROWS = 1 << 17
#: Places that a task gathers before it sorts.
CHUNK_ROWS = 10_000
#: Places in a range between two splitters, on average.
RANGE_ROWS = 40_000

NEVER = U(0xFFFFFFFFFFFFFFFF)


def chosen_places(run: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, place in it and key of each chosen suffix of a run of texts."""
    none = np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(run), np.uint8)
    if len(data) < length:
        return none, none, none
    sizes = np.array([len(r) for r in run])
    first = np.concatenate(([0], np.cumsum(sizes)))
    width = length - KEY_BYTES + 1
    start = np.arange(len(data) - KEY_BYTES + 1)
    hashes = PrefixHash(BYTE_VALUES[data]).of(start, start + KEY_BYTES)
    ranked = (hashes & U(0xFFFFFFFF00000000)) | start.astype(U)
    # least value of each window of `width` places: from the parts on either side of a block edge
    n = len(ranked)
    blocks = np.full(-(-n // width) * width, NEVER, U)
    blocks[:n] = ranked
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    window = np.arange(n - width + 1)
    doc = np.repeat(np.arange(len(run)), sizes)
    window = window[doc[window] == doc[window + length - 1]]
    least = np.minimum(after[window], before[window + width - 1])
    places = (least & U(0xFFFFFFFF)).astype(np.int64)
    places = places[np.concatenate(([True], places[1:] != places[:-1]))] if len(places) else places
    lead = np.zeros(len(places), np.int64)
    for k in range(4):
        lead = (lead << 8) | data[places + k]
    keys = (lead << 32) | (hashes[places] & U(0xFFFFFFFF)).astype(np.int64)
    owner = doc[places]
    return owner, places - first[owner], keys


def _lister(length: int):
    @F.pandas_udf("places array<int>, keys array<long>")
    def listed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for run in steps(batch):
                owner, places, keys = chosen_places(run, length)
                cuts = np.searchsorted(owner, np.arange(len(run) + 1))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    rows.append((places[a:b].astype(np.int32), keys[a:b]))
            yield pd.DataFrame(rows, columns=["places", "keys"])

    return listed


def multikey_order(symbols: np.ndarray) -> np.ndarray:
    """Order of rows of bytes: sort by eight bytes, then only the ties by the next."""
    n, width = symbols.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = symbols
    words = wide.view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="quicksort")
    tied = words[order, 0]
    same = np.concatenate(([False], tied[1:] == tied[:-1]))
    for column in words.T[1:]:
        open_ = same | np.concatenate((same[1:], [False]))
        at = np.flatnonzero(open_)
        if not len(at):
            break
        group = np.cumsum(~same)[at]
        rows = order[at]
        by = np.lexsort((column[rows], group))
        order[at] = rows[by]
        value = column[order[at]]
        # still tied with the row before it: in the same group, with the same word
        again = np.concatenate(([False], (group[1:] == group[:-1]) & (value[1:] == value[:-1])))
        same[at] &= again
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row in order with the row before it; 0 is no symbol."""
    out = np.zeros(len(order), np.int64)
    for k in range(1, len(order), 1 << 14):
        rows = order[k : k + (1 << 14)]
        a, b = symbols[order[k - 1 : k - 1 + len(rows)]], symbols[rows]
        unequal = (a != b) | (a == 0)
        out[k : k + len(b)] = np.where(unequal.any(axis=1), unequal.argmax(axis=1), symbols.shape[1])
    return out


def repeated_reach(before: list[bytes], after: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest r of each place so that the string from r bytes
    before it is repeated; -1 where none is."""
    n, most = len(after), length - KEY_BYTES
    sides = []
    for texts, width, step in ((after, length, 1), (before, most, -1)):
        symbols = np.zeros((n, width), np.uint8)
        for i, t in enumerate(texts):
            symbols[i, : len(t)] = np.frombuffer(t, np.uint8)[::step]
            symbols[i, : len(t)] += 1  # UTF-8 has no FF; 0 stands for the end
        order = multikey_order(symbols)
        sides.append((order, common_prefixes(symbols, order), np.array([len(t) for t in texts])))
    (right, common_right, n_right), (left, common_left, n_left) = sides
    low, high = np.full(n, -1), np.full(n, -1)
    class_right, class_left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in range(most + 1):
        valid = np.flatnonzero((n_left >= r) & (n_right >= length - r))
        if len(valid) < 2:
            continue
        class_right[right] = np.cumsum(common_right < length - r)
        class_left[left] = np.cumsum(common_left < r) if r else 0
        both = class_right[valid] * (n + 1) + class_left[valid]
        by = np.argsort(both)
        same = both[by][1:] == both[by][:-1]
        twice = valid[by[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        low[twice] = np.where(low[twice] < 0, r, low[twice])
        high[twice] = r
    return low, high


def _cutter(length: int):
    """Cut suffixes with the bytes before them out of texts."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["range", "key", "hot", "text_key", "place", "before", "after"]
        for batch in batches:
            rows = []
            columns = [batch[c] for c in ("text", "text_key", "place", "key", "range", "hot")]
            for text, text_key, *chosen in zip(*columns, strict=True):
                raw = text.encode("utf-8", "replace")
                for a, key, part, hot in zip(*(c.tolist() for c in chosen), strict=True):
                    rows.append((part, key, hot, text_key, a, raw[max(0, a - length + KEY_BYTES) : a], raw[a : a + length]))
                if len(rows) > CHUNK_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)
                rows = []

    return cut


CUT = "range int, key long, hot boolean, text_key long, place int, before binary, after binary"


def _by_keys(rows_of, size: int):
    """Apply ``rows_of`` to runs of whole keys of rows that come sorted by key."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            if batch.empty:
                continue
            held.append(batch)
            n += len(batch)
            if n >= size:
                rows = pd.concat(held, ignore_index=True)
                last = rows["key"].iloc[-1]  # its places may go on in the next batch
                whole = int(np.argmax(rows["key"].to_numpy() == last))
                if whole:
                    yield rows_of(rows.iloc[:whole])
                held, n = [rows.iloc[whole:]], len(rows) - whole
        if n:
            yield rows_of(pd.concat(held, ignore_index=True))

    return over


def _sorter(length: int):
    """Spans of the places of whole keys; rows come sorted by key."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = repeated_reach(rows["before"].tolist(), rows["after"].tolist(), length)
        hit = high >= 0
        place = rows["place"].to_numpy()[hit]
        return pd.DataFrame(
            {"text_key": rows["text_key"].to_numpy()[hit], "start": place - high[hit], "end": place - low[hit] + length}
        )

    return _by_keys(found, CHUNK_ROWS)


def _weighted_sorter(length: int):
    """The same for different surroundings with their numbers of places: low and high."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = repeated_reach(rows["before"].tolist(), rows["after"].tolist(), length)
        # surroundings of several places repeat all that is in them
        left = rows["before"].str.len().to_numpy()
        least = np.maximum(0, length - rows["after"].str.len().to_numpy())
        several = (rows["n"].to_numpy() > 1) & (least <= left)
        low, high = np.where(several, least, low), np.where(several, left, high)
        hit = high >= 0
        return pd.DataFrame({"ctx": rows["ctx"][hit], "low": low[hit], "high": high[hit]})

    return _by_keys(found, CHUNK_ROWS)


def _windows(length: int):
    """All strings around a place of a hot key, by hash; r: bytes before the place."""

    @F.pandas_udf("array<struct<r:int,h:binary>>")
    def windows(before: pd.Series, after: pd.Series) -> pd.Series:
        out = []
        for left, right in zip(before, after, strict=True):
            both, a = left + right, len(left)
            out.append(
                [
                    {"r": r, "h": hashlib.blake2b(both[a - r : a - r + length], digest_size=16).digest()}
                    for r in range(len(left) + 1)
                    if len(right) >= length - r
                ]
            )
        return pd.Series(out, dtype=object)

    return windows


def _hot_spans(cuts: DataFrame, length: int, bucket_rows: int, steps_: StepTables) -> DataFrame:
    """Spans of keys with too many places for a bucket."""
    sizes = [F.length(c).cast("string").cast("binary") for c in ("before", "after")]
    ctx = F.md5(F.concat(sizes[0], F.lit(b":"), sizes[1], F.lit(b":"), "before", "after"))
    held = steps_.write("hot", cuts.select("key", "text_key", "place", "before", "after", ctx.alias("ctx")))
    different = held.groupBy("key", "ctx").agg(
        F.first("before").alias("before"), F.first("after").alias("after"), F.count("*").alias("n")
    )
    different = steps_.write("different", different)
    counts = different.groupBy("key").agg(F.count("*").alias("m"))
    fits = counts.where(F.col("m") <= bucket_rows).select("key")
    reach = (
        different.join(fits, "key", "left_semi")
        .repartition("key")
        .sortWithinPartitions("key")
        .select("key", "ctx", "before", "after", "n")
        .mapInPandas(_weighted_sorter(length), "ctx string, low int, high int")
    )
    rest = different.join(fits, "key", "left_anti")
    if rest.limit(1).count():
        each = rest.select("ctx", "n", F.explode(_windows(length)("before", "after")).alias("w")).select("ctx", "n", "w.*")
        each = steps_.write("windows", each)
        # by r too: two places of a text may both surround one and the same string
        twice = each.groupBy("h", "r").agg(F.sum("n").alias("places")).where("places > 1")
        reach = reach.union(each.join(twice, ["h", "r"]).groupBy("ctx").agg(F.min("r").alias("low"), F.max("r").alias("high")))
    return held.join(reach, "ctx").select(
        "text_key", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("end")
    )


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """Two tables by text_key (a 64-bit hash of the text): the texts with their
    number of copies; the spans (start, end in bytes) to remove of each, which may
    overlap. Whole copies aren't in the second: ``digest`` adds them."""
    spark = docs.sparkSession
    steps_ = StepTables(spark)
    keyed = docs.select(whole_text(text).alias("text")).withColumn("text_key", F.xxhash64("text"))
    texts = keyed.groupBy("text_key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    listed = keyed.where(F.octet_length("text") >= length).select("text_key", _lister(length)("text").alias("l"))
    each = F.explode(F.arrays_zip(F.col("l.places").alias("place"), F.col("l.keys").alias("key")))
    places = listed.select("text_key", each.alias("c")).select("text_key", "c.place", "c.key")
    at = F.xxhash64("text_key", "place")
    keys = places.groupBy("key").agg(F.min(at).alias("one"), F.max(at).alias("other"), F.count("*").alias("n"))
    keys = steps_.write("keys", keys.where("one <> other").select("key", "n"))
    total = keys.agg(F.sum(F.least("n", F.lit(bucket_rows)))).first()[0] or 0
    ranges = max(1, total // RANGE_ROWS)
    splitters = []
    if ranges > 1:
        quantiles = [k / ranges for k in range(1, ranges)]
        splitters = sorted(set(keys.agg(F.percentile_approx("key", quantiles, 10_000)).first()[0]))
    edges = F.array(*[F.lit(s) for s in splitters]) if splitters else F.array().cast("array<long>")
    hot = F.col("n") > bucket_rows
    # the bucket of a key: how many splitters are at most as great
    keys = keys.withColumn("range", F.size(F.filter(edges, lambda e: e <= F.col("key"))).cast("int")).withColumn("hot", hot)
    # copies of a text list the same places: a set holds them once, as many as a text has
    names = ["place", "key", "range", "hot"]
    chosen = places.join(keys, "key").groupBy("text_key").agg(F.collect_set(F.struct(*names)).alias("c"))

    def cut(which: DataFrame) -> DataFrame:
        columns = [F.col("c")[c].alias(c) for c in names]
        return texts.join(which, "text_key").select("text", "text_key", *columns).mapInPandas(_cutter(length), CUT)

    cool = chosen.withColumn("c", F.filter("c", lambda x: ~x["hot"])).where(F.size("c") > 0)
    buckets = cut(cool).select("range", "key", "text_key", "place", "before", "after")
    buckets = buckets.repartition("range").sortWithinPartitions("range", "key")
    spans = buckets.mapInPandas(_sorter(length), "text_key long, start int, end int")
    if keys.where("hot").limit(1).count():
        some = chosen.withColumn("c", F.filter("c", lambda x: x["hot"])).where(F.size("c") > 0)
        spans = spans.union(_hot_spans(cut(some), length, bucket_rows, steps_))
    return texts, spans


def _merged(spans, n: int, copies: int, length: int) -> list[tuple[int, int]]:
    if copies > 1 and n >= length:
        return [(0, n)]
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans if s is not None) if spans is not None else ():
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _removed(length: int, with_text: bool):
    kind = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"

    @F.pandas_udf(kind)
    def removed(text: pd.Series, copies: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for own, n_copies, cuts in zip(text, copies, spans, strict=True):
            raw = own.encode("utf-8", "replace")
            runs = _merged(cuts, len(raw), n_copies, length)
            at, parts = 0, []
            for a, b in runs:
                parts.append(raw[at:a])
                at = b
            kept = b"".join([*parts, raw[at:]])
            left = kept.decode("utf-8", "replace") if with_text else None
            rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), left))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    return removed


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, with_text: bool = True, **options) -> DataFrame:
    """text_key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept text
    of every different text of ``docs``; join by ``xxhash64`` of the text.

    Spans may cut characters of several bytes; the digest is of the bytes, the
    kept text has a replacement character there."""
    texts, spans = repeated_spans(docs, text, length, **options)
    spans = spans.groupBy("text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    both = texts.join(spans, "text_key", "left")
    touched = F.col("spans").isNotNull() | ((F.col("copies") > 1) & (F.octet_length("text") >= length))
    plain = F.struct(
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
        (F.col("text") if with_text else F.lit(None).cast("string")).alias("kept"),
    )
    changed = both.where(touched).select("text_key", _removed(length, with_text)("text", "copies", "spans").alias("d"))
    same = both.where(~touched).select("text_key", plain.alias("d"))
    out = changed.union(same).select("text_key", "d.*")
    return out if with_text else out.drop("kept")
