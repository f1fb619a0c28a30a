"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is its sequence of lower-cased words. Its k-mers of five words are labelled with
how often they occurred before; each of ``sketches`` hash functions takes
the ``per_sketch`` labelled k-mers with the least hashes and keeps them in the
order in which they stand in the text. Texts with an equal sketch are
candidates. Because order counts, equal sketches are evidence of a small edit
distance, not only of common words.

1. Equal texts form a class, told apart by the md5 of the text.
2. Every sketch of a class is a bucket key. The members of a bucket are compared with its
   least member first, so that large groups of near copies are joined by n - 1
   pairs. A bucket whose members are then in several groups is open.
3. All pairs of an open bucket that stand in different groups are compared if it has up to
   ``WHOLE`` members, in cells of two blocks of members. Larger ones are compared so too, unless
   their cells hold more rows than their texts have words: then their members are dealt to finer buckets that lose no link: texts within an edit distance have most runs of ``RUN`` words in
   common, so of the runs of each, rarest first, the first few hold a common one. Texts that only share a
   frequent passage have rare runs of their own, and fall apart. Pairs of a finer bucket that share
   a sketch are compared as those of any other, in cells however large it is.
4. Words fall into ``BINS`` bins by their hash. An edit changes the counts of the bins
   by one up and one down at most, so pairs whose counts differ by more than the permitted
   edits can't be links; this needs no texts. In cells this is asked of ``FINE_BINS`` bins too, as
   many words of long texts share a bin of the fewer, where different words cancel out. Counts stop at what
   a place of them holds, which makes differences smaller and loses no pair. A pair is a link if the edit distance of its words, found in a band of the
   greatest width that the similarity permits, is at most 1 - ``similarity`` of
   the longer text. One text of each class is read for this, however often it occurs.
5. Links are joined to groups by alternating star contractions, each written
   to the shared folder; nothing of this passes through the driver.

Texts at five-word similarity s share a sketch with probability about s to the power
``per_sketch``: at 0.8 they have 16 of 32 sketches in common. Every pair that shares one and is a
link is joined, however large its buckets are. Pairs whose edits are scattered so that few five-word
k-mers are left alike are no candidates, whatever their edit similarity.

* Null and empty texts are one class of equal texts, and near to no other.
* Texts of fewer than five words have one k-mer, all their words.
* Repeated rows are copies: one row stays. Ties go to the least doc_id. Unlike texts of
  one doc_id are different documents; each is compared and kept by itself.
* Rows without doc_id are left alone: they get no group and are kept.
* An empty table gives an empty result; extra columns of ``docs`` don't matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.columns import unused, whole_text
from rosterlake.llm.wordhash import VISIBLE, PrefixHash, U, Words, mix, steps
from rosterlake.session import StepTables

KMER_WORDS = 5
SKETCHES = 32
PER_SKETCH = 3
SIMILARITY = 0.8
#: Bins of the word counts that rule out pairs before their texts are read.
BINS = 128
#: Bins of the counts, of four bits each, that rule out pairs of open buckets.
FINE_BINS = 1024
#: Members of an open bucket up to which it is compared whole and not by the rarest runs of its texts.
WHOLE = 256
#: Words of these runs, and the similarity from which two texts that are alike must share one.
RUN = 2
RUN_SIMILARITY = 0.75
#: Sides of joins that all executors may hold, by their counted size.
BROADCAST_BYTES = 16 << 20
#: Members in a block of an open bucket, and pairs whose bins are compared at once.
BLOCK = 512
CHUNK_PAIRS = 2048
#: Pairs whose words are held at once while they are verified.
HELD_PAIRS = 64


def _labelled(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers of words, and each labelled with the number of equal ones before it."""
    start = np.arange(max(1, len(words) - k + 1))
    kmers = PrefixHash(words).of(start, np.minimum(start + k, len(words)))
    by_kmer = np.argsort(kmers, kind="stable")
    ranked = kmers[by_kmer]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    labels = np.empty(len(start), U)
    labels[by_kmer] = mix(ranked + U(0x9E3779B97F4A7C15) * (start - np.maximum.accumulate(np.where(new, start, 0))).astype(U))
    return kmers, labels


def order_sketches(words: np.ndarray, k: int, sketches: int, per_sketch: int) -> np.ndarray:
    """The ordered sketches of a sequence of word hashes; none of an empty one."""
    n = max(1, len(words) - k + 1)
    if not len(words):
        return np.zeros(0, U)
    start = np.arange(n)
    kmers, labels = _labelled(words, k)
    seeds = mix(np.arange(1, sketches + 1, dtype=U) << U(32))
    hashes = (labels[None, :] ^ seeds[:, None]) * (mix(seeds) | U(1))[:, None]
    if n > per_sketch:
        least = np.sort(np.argpartition(hashes, per_sketch - 1, axis=1)[:, :per_sketch], axis=1)
    else:
        least = np.tile(start, (sketches, 1))
    out = seeds
    for column in kmers[least].T:
        out = mix(out * U(31) + column)
    return out


def _rising(values: np.ndarray) -> np.ndarray:
    """Places of a longest increasing run of values, not necessarily adjacent ones."""
    if len(values) < 2 or (values[1:] > values[:-1]).all():
        return np.arange(len(values))
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values.tolist()):
        k = bisect_left(tails, v)
        back[i] = last[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            last.append(i)
        else:
            tails[k], last[k] = v, i
    out, i = [], last[-1]
    while i >= 0:
        out.append(i)
        i = back[i]
    return np.array(out[::-1])


def alignment_bound(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> int:
    """Cost of one alignment: the longest chain of words that occur once on either
    side, and between two of them the best way along their two diagonals."""
    order = np.argsort(at_a)
    left, right = at_a[order], at_b[order]
    chain = _rising(right)
    i = np.concatenate(([-1], left[chain], [len(a)]))
    j = np.concatenate(([-1], right[chain], [len(b)]))
    # gaps of equal length: unequal words on their diagonal
    shift = j - i
    straight = np.repeat(shift[:-1] == shift[1:], np.diff(i))[: len(a)]
    along = np.repeat(shift[:-1], np.diff(i))[: len(a)]
    here = np.arange(len(a))
    # the words from anchor to anchor, the first of each gap being matched already
    words = np.flatnonzero(np.concatenate((straight, np.zeros(len(a) - len(straight), bool))))
    cost = 0
    if len(words):
        partner = here[words] + along[words]
        inside = (partner >= 0) & (partner < len(b))
        cost = int((~inside).sum() + (a[words[inside]] != b[partner[inside]]).sum())
    for g in np.flatnonzero(shift[:-1] != shift[1:]):
        one, other = a[i[g] + 1 : i[g + 1]], b[j[g] + 1 : j[g + 1]]
        n = min(len(one), len(other))
        before = np.concatenate(([0], np.cumsum(one[:n] != other[:n])))
        after = np.concatenate(([0], np.cumsum((one[len(one) - n :] != other[len(other) - n :])[::-1])))[::-1]
        cost += int((before + after).min()) + abs(len(one) - len(other))
    return cost


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance of two sequences if it is at most ``limit``.

    A column of the table of distances is kept as two long integers, whose bits say where
    it rises and falls, so a word of b takes a few operations on all words of a at once.
    """
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return None
    if not n or not m:
        return max(n, m)
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    whole, last = (1 << n) - 1, 1 << (n - 1)
    up, down, cost = whole, 0, n
    for j, word in enumerate(b.tolist(), 1):
        same = places.get(word, 0)
        level = ((((same & up) + up) ^ up) | same | down) & whole
        more, less = down | (whole & ~(level | up)), level & up
        cost += (more & last > 0) - (less & last > 0)
        # each word to come lowers it by one at most
        if cost - (m - j) > limit:
            return None
        more, less = (more << 1 | 1) & whole, less << 1 & whole
        up, down = less | (whole & ~(level | more)), level & more
    return cost


def unmatched(a: np.ndarray, b: np.ndarray, limit: int, k: int) -> int:
    """How many runs of ``k`` words of a stand nowhere in b within ``limit`` places.

    An edit touches ``k`` of them at most, and moves the others by one place at most.
    """
    runs = [w[: max(0, len(w) - k + 1)] for w in (a, b)]
    for i in range(1, k):
        runs = [mix(r * U(31) + w[i : i + len(r)]) for r, w in zip(runs, (a, b), strict=True)]
    if not len(runs[0]) or not len(runs[1]):
        return len(runs[0])
    _, number = np.unique(np.concatenate(runs), return_inverse=True)
    span = max(len(a), len(b)) + limit + 1
    places = np.sort(number[len(runs[0]) :] * span + np.arange(len(runs[1])))
    at, own = np.arange(len(runs[0])), number[: len(runs[0])] * span
    next_ = np.searchsorted(places, own + np.maximum(at - limit, 0))
    there = (next_ < len(places)) & (places[np.minimum(next_, len(places) - 1)] <= own + at + limit)
    return int((~there).sum())


def _counts(words: np.ndarray, bins: int, most: int) -> np.ndarray:
    """How many of the words fall into each bin, ``most`` at most."""
    return np.minimum(np.bincount((words & U(bins - 1)).astype(np.int64), minlength=bins), most)


def _fine_counter():
    @F.pandas_udf("binary")
    def fine(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for run in steps(batch):
                words = Words(run, VISIBLE, lower=True)
                for d in range(len(run)):
                    counts = _counts(words.hash[words.first[d] : words.first[d + 1]], FINE_BINS, 15).astype(np.uint8)
                    out.append((counts[::2] | counts[1::2] << 4).tobytes())  # two to a byte
            yield pd.Series(out, dtype=object)

    return fine


def _sketcher(k: int, sketches: int, per_sketch: int):
    @F.pandas_udf("keys array<long>, bins array<tinyint>, n int")
    def keys(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for run in steps(batch):
                words = Words(run, VISIBLE, lower=True)
                for d in range(len(run)):
                    own = words.hash[words.first[d] : words.first[d + 1]]
                    bins = _counts(own, BINS, 127).astype(np.int8)
                    out.append((order_sketches(own, k, sketches, per_sketch).view(np.int64), bins, len(own)))
            yield pd.DataFrame(out, columns=["keys", "bins", "n"])

    return keys


def may_be_alike(a: Column, b: Column, words: Column, similarity: float) -> Column:
    """Whether counts by bin permit an edit distance that is small enough for so many words."""
    zero = F.lit(0)
    more = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x - y, zero)), zero, lambda acc, x: acc + x)
    fewer = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(y - x, zero)), zero, lambda acc, x: acc + x)
    return F.greatest(more, fewer) <= words * (1 - similarity) + 1e-9


def _cell_pairs(similarity: float):
    def fewest(counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The edits that the counts of words by bin ask for at least, of each pair."""
        held = counts.sum(axis=1, dtype=np.int64)
        more = np.maximum(counts[i] - counts[j], 0).sum(axis=1, dtype=np.int64)
        return np.maximum(more, more - held[i] + held[j])

    @F.pandas_udf("array<long>")
    def pairs(cells: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for buckets, groups, blocks, lengths, fine, keys in cells:
            out = []
            for bucket, group, block, words, packed, own in zip(buckets, groups, blocks, lengths, fine, keys, strict=True):
                # a pair is found once, in the least of the buckets it shares
                before = [set(k[k < bucket].tolist()) for k in map(np.asarray, own)]
                packed = np.frombuffer(b"".join(packed), np.uint8).reshape(len(group), -1)
                counts = np.stack((packed & 15, packed >> 4), axis=2).reshape(len(group), -1).astype(np.int8)
                # sums of bins first, which rule out most at a fraction of the work
                some, few = (counts.reshape(len(group), b, -1).sum(axis=2, dtype=np.int32) for b in (BINS, BINS // 8))
                limit = words * (1 - similarity) + 1e-9
                # two blocks: pairs in one of them stand in their own cell
                other = (block[:, None] != block) | (block[0] == block).all()
                other &= (group[:, None] != group) & (np.abs(words[:, None] - words) <= np.maximum(limit[:, None], limit))
                i, j = np.nonzero(np.triu(other, 1))
                found = []
                for at in range(0, len(i), CHUNK_PAIRS):
                    one, two = i[at : at + CHUNK_PAIRS], j[at : at + CHUNK_PAIRS]
                    for table in (few, some, counts):
                        maybe = fewest(table, one, two) <= np.maximum(limit[one], limit[two])
                        one, two = one[maybe], two[maybe]
                    new = [before[a].isdisjoint(before[b]) for a, b in zip(one.tolist(), two.tolist(), strict=True)]
                    found.append((one * len(group) + two)[np.array(new, bool)])
                out.append(np.concatenate(found) if found else np.zeros(0, np.int64))
            yield pd.Series(out, dtype=object)

    return pairs


def _side(df: DataFrame, size: int | None) -> DataFrame:
    """A side of joins: sent to all executors if its size is counted to be small."""
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def _with_groups(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of buckets that are in several groups: key, node, least (of the group), size."""
    own = shared.join(groups.withColumnRenamed("id", "node"), "node", "left")
    own = own.select("key", "node", F.coalesce("least", "node").alias("least"))
    open_ = own.groupBy("key").agg(F.min("least").alias("low"), F.max("least").alias("high"), F.count("*").alias("size"))
    return own.join(open_.where("low < high").select("key", "size"), "key")


def _all_pairs(members: DataFrame, fine: DataFrame, similarity: float) -> DataFrame:
    """Pairs (node, first) of different groups in a bucket whose words by bin may be alike.

    ``fine`` has the counts of each node and its keys, so that a pair is found in one bucket only;
    without keys it is found in each.
    """
    cells = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    cells = cells.join(fine, "node")
    cells = cells.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = F.struct("node", F.xxhash64("least").alias("group"), "block", "n", "fine", "keys")
    cells = cells.groupBy("key", F.least("block", "with").alias("lower"), F.greatest("block", "with").alias("upper"))
    cells = cells.agg(F.collect_list(member).alias("m"))
    found = _cell_pairs(similarity)("key", "m.group", "m.block", "m.n", "m.fine", "m.keys")
    found = cells.select(F.col("m.node").alias("ids"), F.explode(found).alias("p"))
    # a pair is one number: place of the one times the members, plus that of the other
    one, other = (F.get("ids", F.expr(f"cast(p {sign} size(ids) as int)")) for sign in ("div", "%"))
    return found.select(F.greatest(one, other).alias("node"), F.least(one, other).alias("first"))


def _with_first(members: DataFrame) -> DataFrame:
    """Members (key, node) of buckets of two or more, with the least member and the size;
    the least member itself has no row."""
    buckets = members.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("size"))
    shared = members.join(buckets.where("size > 1"), "key").where("node <> first")
    return shared.select("key", "node", "first", "size")


def _first_pairs(shared: DataFrame, bins: DataFrame, similarity: float) -> DataFrame:
    """Pairs (node, first) of members and the least of their bucket that may be alike."""
    pairs = shared.select("node", "first").distinct()
    first = bins.withColumnsRenamed({"node": "first", "bins": "first_bins", "n": "first_n"})
    pairs = pairs.join(bins, "node").join(first, "first")
    maybe = may_be_alike(F.col("bins"), F.col("first_bins"), F.greatest("n", "first_n"), similarity)
    return pairs.where(maybe).select("node", "first")


def least_shared(n: int, run: int, similarity: float) -> int:
    """How many labelled runs a text of ``n`` words has in common with any that is alike.

    Of the longer text's m words, at most n / similarity, each edit changes ``run`` runs.
    """
    m = np.arange(n, int(n / similarity) + 2)
    edits = ((1 - similarity) * m + 1e-9).astype(np.int64)
    return int((np.maximum(m - run + 1, 1) - run * edits).min())


def _runs(similarity: float):
    run = RUN if similarity >= RUN_SIMILARITY else 1

    @F.pandas_udf("runs array<long>, n int")
    def runs(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for some in steps(batch):
                words = Words(some, VISIBLE, lower=True)
                for d in range(len(some)):
                    own = words.hash[words.first[d] : words.first[d + 1]]
                    labels = _labelled(own, run)[1]
                    out.append((labels.view(np.int64), len(labels) - max(1, least_shared(len(own), run, similarity)) + 1))
            yield pd.DataFrame(out, columns=["runs", "n"])

    return runs


def _by_rare_runs(nodes: DataFrame, texts: DataFrame, similarity: float, steps_: StepTables) -> DataFrame:
    """Buckets (key, node) of two or more of these nodes: any two that are alike share one.

    Texts that are alike have a number of runs in common, whatever their order, so not all of
    these are among the last of either: the runs before those, rarest first, are the keys.
    """
    needed = texts.join(nodes, "node", "left_semi").select("node", _runs(similarity)("t").alias("r"))
    runs = steps_.write("runs", needed.select("node", "r.n", F.explode("r.runs").alias("key")))
    often = runs.groupBy("key").agg(F.count("*").alias("often"))
    ranked = runs.join(often, "key").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("often", "key"))).alias("r"))
    keys = ranked.select("node", F.explode(F.slice("r", 1, F.col("n"))).alias("r")).where("r.often > 1")
    return steps_.write("rare", keys.select("r.key", "node"))


def _alike(similarity: float):
    def within(a: np.ndarray, b: np.ndarray) -> bool:
        limit = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
        in_a, first_a, count_a = np.unique(a, return_index=True, return_counts=True)
        in_b, first_b, count_b = np.unique(b, return_index=True, return_counts=True)
        _, at_a, at_b = np.intersect1d(in_a, in_b, assume_unique=True, return_indices=True)
        if max(len(a), len(b)) - int(np.minimum(count_a[at_a], count_b[at_b]).sum()) > limit:
            return False  # words without a partner need an edit each
        if any(unmatched(x, y, limit, k) > k * limit for x, y in ((a, b), (b, a)) for k in (1, 2)):
            return False
        once = (count_a[at_a] == 1) & (count_b[at_b] == 1)
        if alignment_bound(a, b, first_a[at_a[once]], first_b[at_b[once]]) <= limit:
            return True  # there is an alignment that is good enough
        return banded_distance(a, b, limit) is not None

    @F.pandas_udf("boolean")
    def alike(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            found = []
            for at in range(0, len(left), HELD_PAIRS):
                some = list(zip(left.iloc[at : at + HELD_PAIRS], right.iloc[at : at + HELD_PAIRS], strict=True))
                words = {t: Words([t.encode("utf-8", "replace")], VISIBLE, lower=True).hash for pair in some for t in pair}
                found += [within(words[a], words[b]) for a, b in some]
            yield pd.Series(found, dtype=bool)

    return alike


def connected(edges: DataFrame, steps_: StepTables) -> DataFrame:
    """id and least id of its component, of edges (a, b); only ids with edges.

    Large-star and small-star contractions by turns until every id points at
    its least: each turn is a grouped minimum and a join, so an id of
    any number of edges is never gathered in one place.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = steps_.write("edges", edges.distinct())
    while True:
        # done when every id points at one other, and that at none
        ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in_"))
        ends = ends.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("out").alias("out"), F.max("in_").alias("in_"))
        if not ends.where((F.col("out") > 1) | (F.col("out") > 0) & (F.col("in_") > 0)).count():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("least"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = steps_.write("edges", small.where("a <> b").distinct())


def _texts_of(nodes: DataFrame, classes: DataFrame, texts: DataFrame, steps_: StepTables) -> DataFrame:
    """node and t of these nodes: one text for each class, however often it occurs."""
    needed = classes.select("node", "same").join(nodes.distinct(), "node", "left_semi")
    return steps_.write("texts", texts.join(needed, "same").dropDuplicates(["same"]).select("node", "t"))


def _links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of the pairs (node, first) that are alike, of the texts (node, t)."""
    size = texts.agg(F.sum(F.octet_length("t").cast("long") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:  # then no shuffle deals the pairs out, and a small table of them is one task
        pairs = pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism)
    texts = _side(texts, size)
    both = pairs.join(texts.withColumnRenamed("t", "one"), "node")
    both = both.join(texts.withColumnsRenamed({"node": "first", "t": "other"}), "first")
    return both.where(_alike(similarity)("one", "other")).select(F.col("node").alias("a"), F.col("first").alias("b"))


def _less_in_cells(large: DataFrame, classes: DataFrame) -> bool:
    """Whether cells of these buckets hold no more rows than their texts have words."""
    rows = large.agg(F.sum(F.ceil(F.col("size") / BLOCK))).first()[0] or 0
    return rows <= (classes.join(large, "node", "left_semi").agg(F.sum("n")).first()[0] or 0)


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (node, first) of different groups, with their other columns."""
    one, other = (groups.select(F.col("id").alias(c), F.col("least").alias(f"_{c}")) for c in ("node", "first"))
    own = pairs.join(one, "node", "left").join(other, "first", "left")
    return own.where(F.coalesce("_node", "node") != F.coalesce("_first", "first")).drop("_node", "_first")


def _joined(pairs: DataFrame, groups: DataFrame, texts: DataFrame, similarity: float, steps_: StepTables) -> DataFrame:
    """The groups with the links of pairs (node, first) that were not compared before."""
    pairs = pairs.distinct().join(steps_.union("pairs"), ["node", "first"], "left_anti")
    pairs = steps_.write("pairs", pairs)
    if pairs.isEmpty():
        return groups
    links = _links(pairs, texts, similarity)
    return connected(groups.select(F.col("id").alias("a"), F.col("least").alias("b")).union(links), steps_)


def _groups(classes: DataFrame, texts: DataFrame, similarity: float, sketches: int, steps_: StepTables) -> DataFrame:
    """id and least id of its group, of the classes that are near to another one."""
    n = classes.count()
    bins = _side(classes.select("node", "bins", "n"), n * (BINS + 64))
    keys = _side(classes.select("node", "keys"), n * (8 * sketches + 64))
    members = classes.select("node", F.explode("keys").alias("key"))
    shared = steps_.write("shared", _with_first(members))
    pairs = steps_.write("pairs", _first_pairs(shared, bins, similarity))
    own = _texts_of(pairs.select("node").union(pairs.select("first")), classes, texts, steps_)
    groups = connected(_links(pairs, own, similarity), steps_)
    # the least member has been compared with all of its bucket
    open_ = steps_.write("open", _with_groups(shared.where("size > 2").select("key", "node"), groups))
    if open_.isEmpty():
        return groups
    own = _texts_of(open_.select("node"), classes, texts, steps_)
    fine = own.select("node", _fine_counter()("t").alias("fine")).join(classes.select("node", "n"), "node")
    fine = fine.join(open_.groupBy("node").agg(F.collect_list("key").alias("keys")), "node")
    fine = steps_.write("fine", fine)
    fine = _side(fine, fine.count() * (FINE_BINS // 2 + 8 * sketches + 64))
    large = open_.where(F.col("size") > WHOLE)
    if _less_in_cells(large, classes):
        return _joined(_all_pairs(open_, fine, similarity), groups, own, similarity, steps_)
    large = large.select("node").distinct()
    whole = _all_pairs(open_.where(F.col("size") <= WHOLE), fine, similarity)
    rare = _by_rare_runs(large, own, similarity, steps_)

    def sharing(found: DataFrame) -> DataFrame:
        """Pairs that share a sketch."""
        first_keys = keys.withColumnsRenamed({"node": "first", "keys": "first_keys"})
        found = steps_.write("found", found.distinct()).join(keys, "node").join(first_keys, "first")
        return found.where(F.arrays_overlap("keys", "first_keys")).select("node", "first")

    # as before with the least of each finer bucket first, then all pairs of those still open
    shared = _with_first(steps_.write("open_rare", _with_groups(rare, groups)).select("key", "node"))
    first = _first_pairs(_apart(shared, groups), bins, similarity)
    groups = _joined(whole.unionByName(sharing(first)), groups, own, similarity, steps_)
    open_ = steps_.write("open_rare", _with_groups(shared.where("size > 2").select("key", "node"), groups))
    fine = fine.withColumn("keys", F.array().cast("array<long>"))  # these buckets have other keys
    return _joined(sharing(_all_pairs(open_, fine, similarity)), groups, own, similarity, steps_)


def _grouped(docs: DataFrame, text: str, doc_id: str, similarity: float, kmer_words: int, sketches: int, per_sketch: int):
    """Two tables: id and same (md5 of the text) of each row; and of each text same,
    class_id, group_id, and whether it is the one that stands for its group."""
    steps_ = StepTables(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("t"))
    keys = _sketcher(kmer_words, sketches, per_sketch)
    hashed = texts.select("id", F.md5("t").alias("same"), keys("t").alias("s")).select("id", "same", "s.*")
    rows = steps_.write("rows", hashed)
    classes = rows.groupBy("same").agg(F.min("id").alias("class_id"), F.first("keys").alias("keys"), F.first("bins").alias("bins"), F.first("n").alias("n"))
    # numbers of classes; doc_ids won't do, as unlike texts may share one
    classes = classes.sortWithinPartitions("same").withColumn("node", F.monotonically_increasing_id())
    classes = steps_.write("classes", classes)
    own = classes.where("class_id is not null")
    groups = _groups(own, texts.select(F.md5("t").alias("same"), "t"), similarity, sketches, steps_)
    own = own.select("same", "class_id", "node").join(groups.withColumnRenamed("id", "node"), "node", "left")
    own = steps_.write("own", own.withColumn("least", F.coalesce("least", "node")))
    stands = own.groupBy("least").agg(F.count("*").alias("n"), F.min(F.struct("class_id", "node")).alias("first"))
    found = own.join(stands.where("n > 1"), "least", "left")
    found = found.select(
        "same",
        "class_id",
        F.coalesce("first.class_id", "class_id").alias("group_id"),
        (F.coalesce("first.node", "node") == F.col("node")).alias("stands"),
    )
    none = classes.where("class_id is null")
    none = none.select("same", "class_id", F.col("class_id").alias("group_id"), F.lit(False).alias("stands"))
    return rows.select("id", "same"), found.unionByName(none)


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    similarity: float = SIMILARITY,
    kmer_words: int = KMER_WORDS,
    sketches: int = SKETCHES,
    per_sketch: int = PER_SKETCH,
) -> DataFrame:
    """doc_id, class_id (least id of the equal texts) and group_id (least id
    of the near-duplicates) for every row of ``docs``."""
    rows, found = _grouped(docs, text, doc_id, similarity, kmer_words, sketches, per_sketch)
    return rows.join(found, "same").select(F.col("id").alias("doc_id"), "class_id", "group_id")


def keep_first(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    similarity: float = SIMILARITY,
    kmer_words: int = KMER_WORDS,
    sketches: int = SKETCHES,
    per_sketch: int = PER_SKETCH,
) -> DataFrame:
    """``docs`` with one document of each group: the one with the least id."""
    _, found = _grouped(docs, text, doc_id, similarity, kmer_words, sketches, per_sketch)
    same, kept_id, kept_same = (unused(docs, c) for c in ("_same", "_kept_id", "_kept_same"))
    kept = found.where("stands").select(F.col("class_id").alias(kept_id), F.col("same").alias(kept_same))
    with_id = docs.where(F.col(doc_id).isNotNull()).withColumn(same, F.md5(whole_text(text)))
    first = with_id.join(kept, (F.col(doc_id) == F.col(kept_id)) & (F.col(same) == F.col(kept_same)), "left_semi")
    first = first.dropDuplicates([doc_id, same]).drop(same)
    return first.unionByName(docs.where(F.col(doc_id).isNull()))
