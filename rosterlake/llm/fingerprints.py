"""Document fingerprints by one-permutation MinHash, in Spark expressions only.

Every shingle of five lower-cased words is hashed once. The top bits of a hash say
its bin, and each bin keeps its least hash. An empty bin borrows from the
first filled bin in a pseudo-random sequence that is fixed for each bin (optimal
densification), so two texts agree in a borrowed bin as often as in a filled one. Of
each bin the low ``BITS`` bits are stored, packed into 64-bit words. Unequal values
agree by chance in one of 2**BITS cases; the likeness corrects for that.

* Null and empty texts, and texts of blanks, have the empty fingerprint, which is
  like itself (1) and unlike all others (0).
* Texts of fewer than five words have one shingle, all their words.
* Equal texts have equal fingerprints; repeated rows and extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.columns import unused, whole_text

SHINGLE_WORDS = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 4
PER_LONG = 64 // BITS
BLANKS = " \t\n\x0b\x0c\r"
#: Places tried for an empty bin before all filled bins are ranked.
PROBES = 8

_REST = 64 - BIN_BITS
#: The greatest hash of a bin marks it as empty.
_LAST = (1 << _REST) - 1


def _bin(h: Column) -> Column:
    """0 to BINS - 1, in the order of the signed hashes."""
    return (F.shiftright(h, _REST) + BINS // 2).cast("int")


def _empty(h: Column) -> Column:
    return h.bitwiseAND(F.lit(_LAST)) == _LAST


def _borrowed(slots: Column, filled: Column, j: Column) -> Column:
    """The value that empty bin j takes."""
    tries = []
    for t in range(PROBES):
        value = F.get(slots, F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int"))
        tries.append(F.when(~_empty(value), value))
    ranked = F.transform(filled, lambda v: F.struct(F.xxhash64(j, _bin(v)).alias("rank"), v.alias("v")))
    return F.coalesce(*tries, F.array_min(ranked)["v"])


def add_fingerprint(df: DataFrame, text: str, name: str = "fingerprint") -> DataFrame:
    """``df`` with the packed fingerprint of a column: an array of longs."""
    words, mins, filled = (unused(df, c) for c in ("_words", "_mins", "_filled"))
    split = F.split(F.btrim(F.lower(whole_text(text)), F.lit(BLANKS)), f"[{BLANKS}]+")
    df = df.withColumn(words, split)
    w, n = F.col(words), F.size(words)
    shingles = F.when(
        n >= SHINGLE_WORDS,
        F.transform(F.sequence(F.lit(1), n - (SHINGLE_WORDS - 1)), lambda i: F.xxhash64(F.slice(w, i, SHINGLE_WORDS))),
    ).when(F.element_at(w, 1) != "", F.array(F.xxhash64(w)))
    # a last value for each bin: after sorting, the first of each bin is its least
    lasts = F.array(*[F.lit(((b - BINS // 2) << _REST) + _LAST) for b in range(BINS)])
    df = df.withColumn(mins, F.sort_array(F.concat(shingles, lasts)))
    m = F.col(mins)
    least = F.filter(m, lambda h, i: (i == 0) | (F.shiftright(h, _REST) != F.shiftright(F.get(m, i - 1), _REST)))
    df = df.withColumn(mins, least).withColumn(filled, F.filter(mins, lambda h: ~_empty(h)))
    s, f = F.col(mins), F.col(filled)
    dense = F.when(F.size(f) == BINS, s).otherwise(
        F.transform(s, lambda h, j: F.when(_empty(h), _borrowed(s, f, j)).otherwise(h))
    )
    df = df.withColumn(mins, dense)

    def packed(start: Column) -> Column:
        part = F.slice(F.col(mins), start, PER_LONG)
        low = F.lit((1 << BITS) - 1).cast("long")
        return F.aggregate(part, F.lit(0).cast("long"), lambda acc, h: F.shiftleft(acc, BITS).bitwiseOR(h.bitwiseAND(low)))

    starts = F.array(*[F.lit(k + 1) for k in range(0, BINS, PER_LONG)])
    fingerprint = F.coalesce(F.transform(starts, packed), F.array().cast("array<long>"))
    fingerprint = F.when(F.col(mins).isNotNull(), fingerprint).otherwise(F.array().cast("array<long>"))
    return df.withColumn(name, fingerprint).drop(words, mins, filled)


def as_text(fingerprint: Column) -> Column:
    """The packed bits in hexadecimal; empty of the empty fingerprint."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles of two fingerprints, 0 to 1."""
    ones = F.lit(int("1" * PER_LONG, 16)).cast("long")

    def unequal(x: Column) -> Column:
        folded = x
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(folded.bitwiseAND(ones))

    differing = F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    by_chance = 2.0**-BITS
    corrected = (1 - differing / F.lit(float(BINS)) - by_chance) / (1 - by_chance)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.greatest(F.lit(0.0), corrected))
    )
