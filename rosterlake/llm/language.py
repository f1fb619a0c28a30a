"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary. A word's
probability in a language is the sum over all its segmentations into pieces of
the product of their probabilities, which the forward algorithm adds up from left
to right; a text's is the product over its words. The prediction is the language
of the greatest probability; the score is its share among all languages, which
count as equally likely before.

Piece probabilities are fitted by expectation maximisation: every piece gets the
number of times it's expected in the segmentations of the training words. The
training sample is at most ``sample_docs`` whole texts per language, those with
the least hashes of doc_id, so it doesn't grow with the table.

* ``und`` with score 0 for null and empty texts and texts without a letter.
* Words are runs of letters, digits and characters beyond ASCII after lowering
  A-Z. They are segmented whole, however long; sums are scaled anew every few
  characters, so those of long words stay in the range of doubles.
* Rows with null language or text don't train. Without training rows every
  prediction is ``und``. Equal texts get equal predictions; ties go to the first
  language by code point. Repeated rows and extra columns change nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.wordhash import ALNUM, Words, mix, steps

UNDETERMINED = "und"
SAMPLE_DOCS = 400
ITERATIONS = 4
#: Added to the expected count of each piece.
SMOOTHING = 0.02
#: Characters between two scalings of the sums.
SCALED_CHARS = 16
#: Ends of pieces that are looked up at once in words of one length.
LOOKED_UP = 64
#: Words of up to so many characters are handled with those of their own length only.
SHORT = 40
#: Sums held at once, in words times languages times characters.
HELD = 4_000_000
#: Words remembered by a worker.
MEMORY = 400_000


class Lattice:
    """The vocabulary, as sorted hashes of pieces by their length."""

    def __init__(self, pieces: list[str]) -> None:
        self.size = len(pieces) + 1  # the last is any other single character
        by_length: dict[int, list[tuple[int, int]]] = {}
        for number, piece in enumerate(pieces):
            if piece:
                by_length.setdefault(len(piece), []).append((int(self._hash(self._codes([piece]))[0]), number))
        self.tables = {
            n: (np.array([h for h, _ in sorted(rows)], np.uint64), np.array([i for _, i in sorted(rows)]))
            for n, rows in by_length.items()
        }
        self.longest = max(self.tables, default=1)

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        """Code points of words of one length, a row each."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return flat.reshape(len(words), -1).astype(np.uint64)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), np.uint64)
        for column in codes.T:
            out = mix(out * np.uint64(31) + column + np.uint64(1))
        return out

    def steps(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """From, to, words and pieces of all steps through words of one length, by end."""
        codes = np.ascontiguousarray(self._codes(words).T)
        length = len(codes)
        for low in range(1, length + 1, LOOKED_UP):
            high = min(low + LOOKED_UP, length + 1)
            origin = max(0, low - self.longest)
            running = np.zeros((high - origin, len(words)), np.uint64)
            found = []
            for n in range(1, min(self.longest, high - 1 - origin) + 1):
                # hashes of the n characters from each start on whose end is below high
                rest = running[: high - n - origin]
                running = mix(rest * np.uint64(31) + codes[origin + n - 1 : high - 1] + np.uint64(1))
                if n > 1 and n not in self.tables:
                    continue
                first = max(low, origin + n)
                own = running[first - n - origin :]
                if n in self.tables:
                    hashes, numbers = self.tables[n]
                    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    known, pieces = hashes[at] == own, numbers[at]
                else:
                    known, pieces = np.zeros(own.shape, bool), np.zeros(own.shape, np.int64)
                if n == 1:
                    known, pieces = np.ones(own.shape, bool), np.where(known, pieces, self.size - 1)
                place, rows = np.nonzero(known)
                bounds = np.searchsorted(place + first, np.arange(low, high + 1))
                found.append((n, bounds, rows, pieces[place, rows]))
            for end in range(low, high):
                for n, bounds, rows, pieces in reversed(found):
                    a, b = bounds[end - low], bounds[end - low + 1]
                    if a < b:
                        yield end - n, end, rows[a:b], pieces[a:b]


class Sums:
    """Sums over the segmentations of all beginnings of words of one length.

    The sum of a beginning of t characters is ``of(t) * exp(scale[t // SCALED_CHARS])``, by
    word and language; p holds pieces x languages. Sums of a beginning that no piece can
    reach back to are overwritten unless ``keep``.
    """

    def __init__(self, lattice: Lattice, words: list[str], p: np.ndarray, keep: bool = False) -> None:
        self.words, self.p, self.lattice = words, p, lattice
        length = len(words[0])
        shape = (len(words), p.shape[1])
        self.held = np.zeros((length + 1 if keep else min(length, lattice.longest) + 1, *shape))
        self.scale = np.zeros((length // SCALED_CHARS + 1, *shape))
        self.held[0] = 1

    def of(self, t: int) -> np.ndarray:
        return self.held[t % len(self.held)]

    def step(self, start: int, end: int, rows: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """What a step multiplies its sum by."""
        a, b = start // SCALED_CHARS, end // SCALED_CHARS
        out = self.p[pieces]
        return out if a == b else out * np.exp(self.scale[a, rows] - self.scale[b, rows])

    def run(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """All steps, each after it has been added; those of the next end start anew."""
        last = 0
        for start, end, rows, pieces in self.lattice.steps(self.words):
            if end != last:
                if end % SCALED_CHARS == 0:
                    # every sum is above 0, since any single character is a piece
                    block = end // SCALED_CHARS
                    self.scale[block] = self.scale[block - 1] + np.log(self.of(end - 1))
                self.of(end)[:] = 0
                last = end
            self.of(end)[rows] += self.of(start)[rows] * self.step(start, end, rows, pieces)
            yield start, end, rows, pieces

    def ends(self) -> Iterator[int]:
        """Each end once its sum is whole."""
        last = 0
        for _, end, _, _ in self.run():
            # a step of the next end has been added by now; the ring still holds the one before
            if last and end != last:
                yield last
            last = end
        yield last


def _like_lengths(words: list[str], languages: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Which words, their lengths, and the words, long ones filled up to one length."""
    lengths = np.array([len(w) for w in words], np.int64)
    # long words go with those of up to a quarter more characters
    grade = np.ceil(np.log(np.maximum(lengths, SHORT) / SHORT) / np.log(1.25))
    filled = np.where(lengths <= SHORT, lengths, np.ceil(SHORT * 1.25**grade).astype(np.int64) + 1)
    for n in np.unique(filled):
        same = np.flatnonzero(filled == n)
        most = max(1, int(HELD // (n * max(languages, 1))))
        for k in range(0, len(same), most):
            own = same[k : k + most]
            longest = int(lengths[own].max())
            yield own, lengths[own], [words[i].ljust(longest, "\0") for i in own]


def log_likelihood(lattice: Lattice, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Of each word (row) in each language (column)."""
    marked = ["▁" + w for w in words]
    out = np.zeros((len(words), p.shape[1]))
    for own, lengths, group in _like_lengths(marked, p.shape[1]):
        sums = Sums(lattice, group, p)
        ending = {n: np.flatnonzero(lengths == n) for n in set(lengths.tolist())}
        for end in sums.ends():
            if end in ending:
                rows = ending[end]
                out[own[rows]] = np.log(sums.of(end)[rows]) + sums.scale[end // SCALED_CHARS, rows]
    return out


def fit(lattice: Lattice, words: list[str], counts: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Piece probabilities by language, of counts of words by language."""
    marked = ["▁" + w for w in words]
    p = np.full((lattice.size, counts.shape[1]), 1 / lattice.size)
    for _ in range(iterations):
        expected = np.full_like(p, SMOOTHING)
        for own, lengths, group in _like_lengths(marked, p.shape[1]):
            sums = Sums(lattice, group, p, keep=True)
            taken = list(sums.run())
            rest = np.zeros_like(sums.held)
            each = np.arange(len(own))
            rest[lengths, each] = counts[own] / sums.held[lengths, each]
            for start, end, rows, pieces in reversed(taken):
                back = rest[end, rows] * sums.step(start, end, rows, pieces)
                rest[start, rows] += back
                share = sums.held[start, rows] * back
                for language in range(p.shape[1]):
                    expected[:, language] += np.bincount(pieces, share[:, language], len(p))
        p = expected / expected.sum(axis=0)
    return p


@dataclass
class Model:
    languages: list[str]
    lattice: Lattice
    p: np.ndarray


def train(labelled: DataFrame, pieces: list[str], sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on a sample of (doc_id, text, lang); null text or lang doesn't train."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    rows = rows.withColumn("h", F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    # a few times the sample passes the hash; the rank then makes it exact
    share = F.lit(0.0)
    for lang, n in counts:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * sample_docs / n + 50 / n))).otherwise(share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    sample = rows.where(F.col("h") <= share).withColumn("r", rank).where(F.col("r") <= sample_docs)
    languages = sorted((r["lang"] for r in counts), key=lambda s: s.encode())
    number = {lang: i for i, lang in enumerate(languages)}
    tally: dict[bytes, np.ndarray] = {}
    for row in sample.select("text", "lang").toLocalIterator():
        for run in steps([row["text"]]):
            words = Words(run, ALNUM, lower=True)
            for i in range(len(words.hash)):
                own = tally.setdefault(words.text(i), np.zeros(len(languages)))
                own[number[row["lang"]]] += 1
    lattice = Lattice(pieces)
    ordered = sorted(tally)
    counts_by_word = np.array([tally[w] for w in ordered]).reshape(len(ordered), len(languages))
    p = fit(lattice, [w.decode("utf-8", "replace") for w in ordered], counts_by_word)
    return Model(languages, lattice, p)


class Scorer:
    """Log likelihoods of texts; those of words are remembered."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.known = np.zeros((1024, len(self.model.languages)))

    def of_words(self, words: Words) -> np.ndarray:
        distinct, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.place) + len(distinct) > MEMORY:
            self._clear()
        keys = distinct.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.place]
        if new:
            texts = [words.text(at[i]).decode("utf-8", "replace") for i in new]
            values = log_likelihood(self.model.lattice, self.model.p, texts)
            first = len(self.place)
            while len(self.known) < first + len(new):
                self.known = np.concatenate((self.known, np.zeros_like(self.known)))
            self.known[first : first + len(new)] = values
            self.place.update((keys[i], first + k) for k, i in enumerate(new))
        rows = np.array([self.place[h] for h in keys], np.int64)
        return self.known[rows[back]]

    def predict(self, texts: pd.Series) -> Iterator[tuple[str, float]]:
        languages = self.model.languages
        for run in steps(texts):
            words = Words(run, ALNUM, lower=True)
            running = np.zeros((len(words.hash) + 1, len(languages)))
            if len(words.hash):
                np.cumsum(self.of_words(words), axis=0, out=running[1:])
            total = running[words.first[1:]] - running[words.first[:-1]]
            total -= total.max(axis=1, keepdims=True)
            share = np.exp(total)
            best = total.argmax(axis=1)
            for row, b, s in zip(range(len(run)), best, share.sum(axis=1), strict=True):
                yield languages[b], float(share[row, b] / s)


def predict(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct column ``name``: lang and score."""
    if not model.languages:
        return docs.withColumn(name, _undetermined())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(shared)
        for batch in batches:
            yield pd.DataFrame(list(scorer.predict(batch)), columns=["lang", "score"])

    spoken = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(name, F.when(spoken, scored(F.col(text))).otherwise(_undetermined()))


def _undetermined() -> Column:
    return F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"))


_scorers: dict[int, Scorer] = {}


def _scorer(shared) -> Scorer:
    """A worker's scorer of a model: words it knows serve its later tasks too."""
    model = shared.value
    if id(model) not in _scorers:
        _scorers.clear()
        _scorers[id(model)] = Scorer(model)
    return _scorers[id(model)]


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model; unknown and control pieces as ''."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [
        "" if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) else model.id_to_piece(i)
        for i in range(model.get_piece_size())
    ]


def confident(name: str = "language", least: float = 0.5) -> Column:
    return (F.col(name)["lang"] != UNDETERMINED) & (F.col(name)["score"] >= least)
