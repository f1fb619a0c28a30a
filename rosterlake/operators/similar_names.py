"""Names that are nearly the same: a set-similarity join on their q-grams.

Names are compared by their canonical keys ("X, Department of" is "X"), each key once per
scope. Two keys are similar if their sets of q-grams have a Jaccard similarity of at
least ``similarity``. No pair is looked at without a reason:

* Prefix filter: with q-grams ordered by how rare they are, similar sets of n q-grams share
  one of their first n - ceil(similarity * n) + 1. Only these are joined, so the
  q-grams that many names have hardly ever are.
* Length filter: the smaller set has at least ``similarity`` times the q-grams of the larger.
* Positional filter: what stands after the first q-gram that two sets share in that order bounds
  how many they can have in common at all.

What passes is verified on the whole sets in the same join, at the first q-gram that both share,
so candidates are neither shuffled nor compared twice. Names with different distinguishing words
("Applied Physics", "Physics") are never similar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .dedup import canonical_name_key

Q = 3
SIMILARITY = 0.6
#: Words that set a name apart from the one without them.
DISTINGUISHING = ("applied", "clinical", "computational", "experimental", "theoretical")


def q_grams(key: Column, q: int = Q) -> Column:
    """The different runs of ``q`` characters of a key with blanks around it."""
    padded = F.concat(F.lit(" " * (q - 1)), key, F.lit(" " * (q - 1)))
    starts = F.sequence(F.lit(1), F.length(padded) - (q - 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(q))))


def marks(key: Column, words: tuple[str, ...] = DISTINGUISHING) -> Column:
    """The distinguishing words of a key, in fixed order."""
    own = F.split(key, "[^a-z0-9]+")
    return F.array(*[F.array_contains(own, w) for w in words])


def similar_names(
    names: DataFrame,
    name: str = "name",
    scope: tuple[str, ...] = (),
    similarity: float = SIMILARITY,
    q: int = Q,
    distinguishing: tuple[str, ...] = DISTINGUISHING,
) -> DataFrame:
    """(scope, key, other, n_common, n_either): pairs of similar keys, ``key`` < ``other``.

    ``n_common`` of the ``n_either`` q-grams of two keys are in both. Blank names
    have no key. Scopes that are NULL match each other.
    """
    # whole numbers: a sum of doubles must not decide on which side of the threshold a pair is
    share = round(similarity * 1_000_000)
    # few bytes, but much work on each name and far more pairs: adaptive execution would give
    # them to one task. Each spelling is worked on once
    spark = names.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spelled = names.select(*scope, F.col(name).alias("_name")).distinct().repartition(tasks, "_name")
    keys = spelled.where(~X.is_blank("_name")).select(*scope, canonical_name_key("_name").alias("key"))
    keys = keys.where("key <> ''").distinct().repartition(tasks, "key").withColumn("grams", q_grams(F.col("key"), q))
    keys = keys.withColumn("marks", marks(F.col("key"), distinguishing))
    place = F.struct(*[F.col(c).alias(c) for c in scope], F.col("key").alias("key"))
    each = keys.select(place.alias("id"), "marks", F.explode("grams").alias("gram"))
    rarity = each.groupBy("gram").agg(F.count("*").alias("holders"))
    # one order of all q-grams, the rare ones first
    order = F.struct("holders", F.xxhash64("gram").alias("hash"), "gram")
    own = each.join(rarity, "gram").groupBy("id").agg(
        F.first("marks").alias("marks"), F.sort_array(F.collect_list(order)).alias("grams")
    )
    own = own.select("id", "marks", F.size("grams").alias("n"), F.col("grams.gram").alias("grams"))
    needed = F.ceil(F.col("n") * share / 1_000_000).cast("int")
    first = own.select("*", F.posexplode(F.slice("grams", F.lit(1), F.col("n") - needed + 1)).alias("at", "gram"))
    meeting = F.struct(*[F.col("id")[c].alias(c) for c in scope], "marks", "gram")
    first = first.withColumn("meeting", meeting).drop("marks").repartition(tasks, "meeting")

    one, other = first.alias("a"), first.alias("b")
    same = F.col("a.meeting") == F.col("b.meeting")
    n, m, at, to = (F.col(c) for c in ("a.n", "b.n", "a.at", "b.at"))
    most = F.least(n - at, m - to)
    pairs = one.join(other, same & (F.col("a.id")["key"] < F.col("b.id")["key"]))
    pairs = pairs.where((n * 1_000_000 >= m * share) & (m * 1_000_000 >= n * share))
    # common / either >= s  <=>  common * (1 + s) >= s * (n + m)
    pairs = pairs.where(most * (1_000_000 + share) >= (n + m) * share)
    # a pair is verified where it first meets, so it is found once and never shuffled
    common = F.array_intersect("a.grams", "b.grams")
    ok = lambda c: (F.get(c, F.lit(0)) == F.col("a.gram")) & (F.size(c) * (1_000_000 + share) >= (n + m) * share)
    found = pairs.where(F.exists(F.array(common), ok)).select(
        F.col("a.id").alias("id"),
        F.col("b.id").alias("to"),
        F.size(common).cast("bigint").alias("n_common"),
        (n + m).alias("both"),
    )
    found = found.withColumn("n_either", F.col("both") - F.col("n_common"))
    return found.select(
        *[F.col("id")[c].alias(c) for c in scope],
        F.col("id")["key"].alias("key"),
        F.col("to")["key"].alias("other"),
        "n_common",
        "n_either",
    )
