"""Ranked lexical search by NRA: sorted reads only, with intervals for every score.

A document's score for an item is the sum of its impacts in the items' terms. Documents
are held in blocks; a block has one list per term, sorted by descending impact. For each
item the lists of its terms are read in step, from the top, and never at random:

* what was read of a document is the lower end of its score's interval;
* for each term not read of it yet, the upper end adds the impact that the list has come
  down to - or nothing, if a single occurrence in a document of that length would
  already stand above it, so that the document can't hold the term.

A document whose upper end is below the k-th best lower end is out. Reading goes on, in
growing steps and only in lists that still matter to a document that isn't out, until
the ends meet for all of those: so membership, ties and final scores are settled.

The best of a block are exact, so the best of all blocks are the best of the table; one
window over k rows per block and item puts them together. Blocks keep frequent
terms apart: the list of a word that all documents have is as long as a block, never
as the table. Of the statistics, documents, words and documents per term are counted over
all blocks first; impacts are whole numbers, computed once they are known.

Items go to the executors in slices of ``SLICE_BYTES`` of their text, each a pass of its
own; equal items are searched once. Terms are compared byte by byte, not by hash.

* Null and empty texts have no terms: such documents count nowhere, such items get no row.
* Null doc_ids come last among equal scores; null item_ids are ids like others.
* Repeated documents are documents of their own, repeated items get the same rows each.
* An empty table on either side gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.wordhash import ALNUM, U, Words, steps
from rosterlake.session import StepTables

K = 10
#: Documents in a block at most, and entries of lists from which a block is closed.
BLOCK_DOCS = 4096
BLOCK_ENTRIES = 1 << 19
#: Text of the items that are searched in one pass.
SLICE_BYTES = 4 << 20
#: Entries read of each list in the first step; each later step reads twice as many.
FIRST_READ = 64

#: Of the score: an impact is SCALE * tf div (1000 * tf + 8 * m) with m = 10 + 90 * n * N div L.
SCALE = 1_000_000_000

BLOCK = "docs long, words long, ids binary, no_id binary, lengths binary, term binary, doc binary, tf binary"


class Terms:
    """The different terms of a slice of items, to be found among the words of texts."""

    def __init__(self, texts: list[str]) -> None:
        number: dict[bytes, int] = {}
        hashes: list[int] = []
        self.items: list[np.ndarray] = []
        for text in texts:
            own = []
            for run in steps([text]):
                words = Words(run, ALNUM, lower=True)
                for i in range(len(words.hash)):
                    word = words.text(i)
                    if word not in number:
                        number[word] = len(number)
                        hashes.append(int(words.hash[i]))
                    own.append(number[word])
            self.items.append(np.unique(np.array(own, np.int64)))
        order = np.argsort(np.array(hashes, U), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.items = [np.sort(rank[own]) for own in self.items]
        self.hash = np.array(hashes, U)[order]
        spelled = list(number)
        spelled = [spelled[i] for i in order]
        self.ends = np.cumsum([0] + [len(s) for s in spelled])
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        # words of one hash stand together; as many are tried for each find
        self.same = int(np.unique(self.hash, return_counts=True)[1].max(initial=0))

    def __len__(self) -> int:
        return len(self.hash)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and which ones."""
        place = np.searchsorted(self.hash, words.hash)
        found_words, found_terms = [], []
        for step in range(self.same):
            at = np.minimum(place + step, len(self) - 1)
            hit = np.flatnonzero((self.hash[at] == words.hash) & (place + step < len(self)))
            term = at[hit]
            start, size = words.start[hit], words.end[hit] - words.start[hit]
            alike = size == self.ends[term + 1] - self.ends[term]
            for i in range(int(size[alike].max(initial=0))):
                on = np.flatnonzero(alike & (size > i))
                alike[on] = words.buffer[start[on] + i] == self.bytes[self.ends[term[on]] + i]
            found_words.append(hit[alike])
            found_terms.append(term[alike])
        return np.concatenate(found_words), np.concatenate(found_terms)


def _rows(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kind) for c, (_, kind) in zip(columns, schema, strict=True)], names=[n for n, _ in schema]
    )


class _Open:
    """The block that is being filled."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.no_id: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.entries: list[tuple[np.ndarray, ...]] = []
        self.docs = self.size = 0

    def add(self, words: Words, terms: Terms, ids: np.ndarray, no_id: np.ndarray) -> None:
        word, term = terms.find(words)
        pair, tf = np.unique(words.doc[word] * len(terms) + term, return_counts=True)
        self.entries.append((pair % len(terms), pair // len(terms) + self.docs, tf))
        self.lengths.append(np.diff(words.first))
        self.ids.append(ids)
        self.no_id.append(no_id)
        self.docs += len(ids)
        self.size += len(pair)

    def row(self) -> tuple:
        n = np.concatenate(self.lengths)
        packed = [np.concatenate([e[i] for e in self.entries]).astype("<i4").tobytes() for i in range(3)]
        ids = np.concatenate(self.ids).astype("<i8").tobytes()
        none = np.concatenate(self.no_id).tobytes()
        return int((n > 0).sum()), int(n.sum()), ids, none, n.astype("<i8").tobytes(), *packed


def _blocks(broadcast, block_docs: int, block_entries: int):
    """Documents to blocks: ids and lengths, and how often which term is in which."""
    names = [c.split()[0] for c in BLOCK.split(", ")]
    schema = [(n, pa.int64() if n in ("docs", "words") else pa.binary()) for n in names]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: Terms = broadcast.value
        block = _Open()
        for batch in batches:
            no_id = batch.column("id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False)
            at = 0
            for run in steps(batch.column("t").to_pylist()):
                for low in range(0, len(run), block_docs):
                    part = run[low : low + block_docs]
                    if block.docs and (block.docs + len(part) > block_docs or block.size > block_entries):
                        yield _rows([block.row()], schema)
                        block = _Open()
                    to = at + len(part)
                    block.add(Words(part, ALNUM, lower=True), terms, ids[at:to], no_id[at:to])
                    at = to
        if block.docs:
            yield _rows([block.row()], schema)

    return blocks


class Lists:
    """The impact-sorted lists of a block, with the statistics of the whole table."""

    def __init__(self, row, n_docs: int, n_words: int, terms: int) -> None:
        length = np.frombuffer(row["lengths"], "<i8")
        term, doc, tf = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("term", "doc", "tf"))
        # 90 * n * N may leave 64 bits where documents are huge: whole numbers of Python then
        big = int(length.max(initial=0)) * 90 * n_docs >= 1 << 62
        m = np.array([10 + 90 * int(n) * n_docs // n_words for n in length], np.int64) if big else 10 + 90 * length * n_docs // n_words
        impact = SCALE * tf // (1000 * tf + 8 * m[doc])
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(terms + 1))
        #: the impact of one occurrence: no document holds a term with less
        self.least = SCALE // (1000 + 8 * m)
        self.ids, self.no_id = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["no_id"], bool)
        self.size = len(length)


def nra(lists: Lists, terms: np.ndarray, weights: np.ndarray, k: int, first_read: int = FIRST_READ):
    """Documents (by place) and scores: all that are among the ``k`` best or tie with them."""
    at, end = lists.start[terms].copy(), lists.start[terms + 1]
    lower = np.zeros(lists.size, np.int64)
    read = np.zeros((len(terms), lists.size), bool)
    # what an unread document may still have in a list: at most what was read last
    come_to = np.where(at < end, lists.impact[np.minimum(at, max(0, len(lists.impact) - 1))] if len(lists.impact) else 0, 0)
    alive = np.arange(lists.size)
    open_ = at < end
    step = first_read
    while True:
        n = np.where(open_, np.minimum(end - at, step), 0)
        which = np.repeat(np.arange(len(terms)), n)
        entry = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
        docs = lists.doc[entry]
        np.add.at(lower, docs, lists.impact[entry] * weights[which])
        read[which, docs] = True
        at = at + n
        last = lists.impact[np.maximum(at - 1, 0)] if len(lists.impact) else come_to
        come_to = np.where(at >= end, 0, np.where(n > 0, last, come_to))
        best = lower[alive]
        floor = max(1, int(np.partition(best, -k)[-k])) if len(best) >= k else 1
        unsettled = ~read[:, alive] & (come_to[:, None] >= lists.least[alive][None, :])
        upper = best + (weights * come_to) @ unsettled
        keep = upper >= floor
        alive, unsettled = alive[keep], unsettled[:, keep]
        if not (upper[keep] > lower[alive]).any():
            return alive, lower[alive]
        open_ = (at < end) & unsettled.any(axis=1)
        step *= 2


def _searcher(broadcast, k: int):
    schema = [("number", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_words = broadcast.value
        for batch in batches:
            for row in batch.to_pylist():
                lists = Lists(row, n_docs, n_words, len(weights))
                out = []
                for number, terms in enumerate(items):
                    if len(terms):
                        docs, scores = nra(lists, terms, weights[terms], k)
                        order = np.lexsort((lists.ids[docs], lists.no_id[docs], -scores))[:k]
                        for d, score in zip(docs[order], scores[order], strict=True):
                            out.append((number, None if lists.no_id[d] else int(lists.ids[d]), int(score)))
                yield _rows(out, schema)

    return search


def _document_counts(terms: int):
    schema = [("term", pa.int32()), ("n", pa.int64())]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for packed in batch.column("term").to_pylist():
                total += np.bincount(np.frombuffer(packed, "<i4"), minlength=terms)
        held = np.flatnonzero(total)
        yield _rows(list(zip(held.tolist(), total[held].tolist(), strict=True)), schema)

    return counts


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    slice_bytes: int = SLICE_BYTES,
    block_docs: int = BLOCK_DOCS,
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item, fewer if
    fewer have a term of it."""
    spark = docs.sparkSession
    tables = StepTables(spark)
    wanted = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")).where("t is not null")
    wanted = tables.write("items", wanted.groupBy("item_id", "t").agg(F.count("*").alias("copies")))
    size = wanted.agg(F.sum(F.octet_length("t").cast("long") + 64)).first()[0] or 0
    slices = max(1, math.ceil(size / slice_bytes))
    searched = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    names = wanted.select("item_id", "copies").schema
    found = None
    for number in range(slices):
        part = wanted.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(slices)) == number).collect()
        terms = Terms([row["t"] for row in part])
        if not len(terms):
            continue
        shared = spark.sparkContext.broadcast(terms)
        blocks = tables.write("blocks", searched.mapInArrow(_blocks(shared, block_docs, block_entries), BLOCK))
        n_docs, n_words = blocks.agg(F.sum("docs"), F.sum("words")).first()
        if not n_words:
            break
        holders = blocks.select("term").mapInArrow(_document_counts(len(terms)), "term int, n long")
        holders = dict(holders.groupBy("term").agg(F.sum("n")).collect())
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders.get(t, 0) + 1))) for t in range(len(terms))]
        known = spark.sparkContext.broadcast((terms.items, np.array(weights, np.int64), n_docs, n_words))
        best = tables.write("best", blocks.mapInArrow(_searcher(known, k), "number int, doc_id long, score long"))
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = spark.createDataFrame(
            [(i, row["item_id"], row["copies"]) for i, row in enumerate(part)],
            f"number int, item_id {names['item_id'].dataType.simpleString()}, copies long",
        )
        best = best.join(F.broadcast(named), "number").select("item_id", "copies", "rank", "doc_id", "score")
        found = tables.write("found", best)
        for used in (shared, known):
            used.unpersist()
    if found is None:
        nothing = [F.lit(None).cast(t) for t in ("int", "long", "long")]
        found = wanted.where("false").select("item_id", "copies", *[c.alias(n) for c, n in zip(nothing, ("rank", "doc_id", "score"), strict=True)])
    else:
        found = tables.union("found")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return found.withColumn("copy", times).select("item_id", "rank", "doc_id", "score")
