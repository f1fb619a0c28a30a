import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import repeats

from .rows import awkward, clashing, empty


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def found(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    rows = keyed.join(repeats.remove_repeats(docs, **options), "text_key").collect()
    return [tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in sorted(rows, key=lambda r: r["doc_id"])]


def passages(seed):
    rng = random.Random(seed)
    letters = "abcdeéf \n\x00" if seed % 2 else "ab"
    parts = ["".join(rng.choices(letters, k=rng.choice([40, 150, 210, 400]))) for _ in range(8)]
    texts = []
    for _ in range(25):
        own = [rng.choice(parts)[rng.randrange(30) :] if rng.random() < 0.6 else "".join(rng.choices("uvwxyz", k=rng.randrange(300))) for _ in range(rng.randrange(6))]
        texts.append("".join(own))
    return [*texts, "", "xy" * 300, "q" * 700, parts[0], parts[0]]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("bucket_rows", [repeats.BUCKET_ROWS, 3])
def test_equals_brute_force(spark, seed, bucket_rows):
    texts = passages(seed)
    assert found(spark, texts, bucket_rows=bucket_rows) == brute([t.encode() for t in texts], 200)


def test_many_ranges_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "RANGE_ROWS", 5)
    texts = passages(7)
    assert found(spark, texts) == brute([t.encode() for t in texts], 200)


def test_chunks_of_whole_keys(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(repeats, "CHUNK_ROWS", 4)
    raw = [t.encode() for t in passages(3)]
    rows = []
    for d, t in enumerate(raw):
        for _, place, key in zip(*repeats.chosen_places([t], 200), strict=True):
            rows.append((0, key, False, d, place, t[max(0, place - 150) : place], t[place : place + 200]))
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in repeats.CUT.split(", ")]).sort_values("key", kind="stable")
    batches = [frame.iloc[k : k + 3] for k in range(0, len(frame), 3)]
    gone = [bytearray(len(t)) for t in raw]
    for part in repeats._sorter(200)(iter(batches)):
        for d, a, b in part.itertuples(index=False):
            gone[d][a:b] = b"\1" * (b - a)
    assert [sum(g) for g in gone] == [n for _, n, _, _ in brute(raw, 200)]


def test_multikey_order_is_the_order_of_bytes():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (500, 21)).astype(np.uint8)
    rows[::7] = rows[0]
    order = repeats.multikey_order(rows)
    got = [rows[i].tobytes() for i in order]
    assert got == sorted(r.tobytes() for r in rows)
    common = repeats.common_prefixes(rows, order)
    for k in range(1, 500):
        a, b = got[k - 1], got[k]
        assert common[k] == next((i for i in range(21) if a[i] != b[i]), 21)


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    by = {r["n_bytes"]: r for r in repeats.remove_repeats(docs).collect()}
    assert len(by) >= 6 and all(r["n_removed"] == 0 for r in by.values())
    assert repeats.remove_repeats(empty(spark)).count() == 0
    twice = awkward(spark).union(awkward(spark)).where("doc_id = 6")
    (row,) = repeats.remove_repeats(twice).collect()
    assert row["n_removed"] == row["n_bytes"] and row["kept"] == "" and row["n_spans"] == 1
