import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import language
from rosterlake.llm.models import PIECES, language_model, public_file

from .rows import awkward, clashing, empty

SPOKEN = {
    "en": "the king and the queen were walking with their children through the garden in the morning",
    "de": "der könig und die königin gingen mit ihren kindern am morgen durch den garten und die wiese",
    "fr": "le roi et la reine marchaient avec leurs enfants dans le jardin pendant la matinée douce",
}


def brute(lattice_pieces, p, word):
    """The sum over all segmentations of the product of piece probabilities."""
    number = {piece: i for i, piece in enumerate(lattice_pieces) if piece}
    total = 0.0
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        parts, last = [], 0
        for k, cut in enumerate(cuts, 1):
            if cut:
                parts.append(word[last:k])
                last = k
        parts.append(word[last:])
        if all(part in number or len(part) == 1 for part in parts):
            total += math.prod(p[number.get(part, len(lattice_pieces))] for part in parts)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "", "aba"]
    lattice = language.Lattice(pieces)
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(len(pieces) + 1), 2).T
    words = ["a", "ab", "abab", "bb", "abazab", "ü"]
    got = language.log_likelihood(lattice, p, words)
    for row, w in zip(got, words, strict=True):
        for k in range(2):
            assert row[k] == pytest.approx(math.log(brute(pieces, p[:, k], "▁" + w)))


def by_recursion(pieces, p, word):
    """The logarithm of the sum, in exact fractions from left to right."""
    number = {piece: i for i, piece in enumerate(pieces) if piece}
    exact = [Fraction(float(x)) for x in p]
    sums = [Fraction(1)]
    for end in range(1, len(word) + 1):
        total = Fraction(0)
        for start in range(max(0, end - 4), end):
            part = word[start:end]
            if part in number or len(part) == 1:
                total += sums[start] * exact[number.get(part, len(pieces))]
        sums.append(total)
    last = sums[-1]
    return (math.log(last.numerator) - math.log(last.denominator)) if last else -math.inf


def test_long_words_are_segmented_whole():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "abab", "", "aba"]
    lattice = language.Lattice(pieces)
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(len(pieces) + 1, 0.3), 3).T + 1e-9
    words = ["".join(rng.choice(list("abü"), n)) for n in (1, 15, 16, 17, 39, 40, 41, 63, 64, 65, 80, 81, 400)] * 2
    got = language.log_likelihood(lattice, p, words)
    for row, w in zip(got, words, strict=True):
        assert row == pytest.approx([by_recursion(pieces, p[:, k], "▁" + w) for k in range(3)], rel=1e-9)


def test_very_long_words_still_tell_languages_apart():
    lattice = language.Lattice(["▁", "a", "b", "ab"])
    p = np.array([[0.2, 0.2], [0.3, 1e-7], [1e-7, 0.3], [0.2, 0.2], [0.3, 0.3]])
    got = language.log_likelihood(lattice, p, ["a" * 20_000, "b" * 20_000])
    assert np.isfinite(got).all() and got[0, 0] - got[0, 1] > 100_000 and got[1, 1] - got[1, 0] > 100_000


def test_expected_counts_of_long_words():
    lattice = language.Lattice(["▁", "a", "b", "ab", "ba"])
    word = "ab" * 150
    p = language.fit(lattice, [word, "ab"], np.array([[3.0], [1.0]]), 6)
    assert np.isfinite(p).all() and np.isclose(p.sum(), 1)
    assert p[3, 0] > 0.9 * (1 - p[0, 0])


def test_fitting_raises_the_likelihood():
    lattice = language.Lattice(["▁", "a", "b", "ab", "▁ab", "ba"])
    words, counts = ["abab", "ba", "aab"], np.array([[5.0], [2.0], [3.0]])
    last = -np.inf
    for n in range(1, 5):
        p = language.fit(lattice, words, counts, n)
        now = float((language.log_likelihood(lattice, p, words) * counts).sum())
        assert now >= last - 0.2 and np.isclose(p.sum(), 1)
        last = now


def corpus(spark):
    rows = []
    for k, (lang, text) in enumerate(SPOKEN.items()):
        own = text.split()
        for i in range(40):
            rows.append((k * 100 + i, " ".join(own[(i * 5 + j * 3) % len(own)] for j in range(30)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    out = language.predict(docs.drop("lang"), language_model(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["language"]["lang"] == r["lang"] and 0 <= r["language"]["score"] <= 1 for r in out)


def test_awkward_rows(spark):
    model = language_model(corpus(spark))
    docs = clashing(awkward(spark))
    out = {r["doc_id"]: r["language"] for r in language.predict(docs, model).collect()}
    assert all(out[i]["lang"] == "und" and out[i]["score"] == 0 for i in (3, 4, 5, 7))
    assert all(out[i]["lang"] in SPOKEN for i in (1, 6, 8, 9))
    assert language.predict(empty(spark), model).count() == 0


def test_nothing_to_learn_from(spark):
    model = language.train(empty(spark), language.vocabulary(public_file(PIECES)))
    out = language.predict(awkward(spark), model).select(F.col("language")["lang"]).distinct().collect()
    assert [r[0] for r in out] == ["und"]


def test_sample_is_bounded(spark):
    rows = [(i, f"w{i}", "xx") for i in range(500)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["▁", "w"], sample_docs=10)
    assert model.languages == ["xx"]
