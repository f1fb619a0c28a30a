import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import fill_middle

from .rows import awkward, clashing, empty


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("error", [0, 1, 7, 64])
def test_segments_keep_the_error(seed, error):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 3000))
    steps = rng.integers(1, 200, n) if seed % 2 else np.repeat(rng.integers(1, 50, n // 10 + 1), 10)[:n]
    offsets = np.concatenate(([0], np.cumsum(steps)))
    found = fill_middle.segments(offsets, error)
    assert [s[0] for s in found] == sorted({s[0] for s in found}) and found[0][0] == 0
    for (first, start, slope), end in zip(found, [s[0] for s in found[1:]] + [len(offsets)], strict=True):
        assert np.abs(start + slope * np.arange(end - first) - offsets[first:end]).max() <= error + 1e-6
    if error and not seed % 2:
        assert len(found) < n / 4  # runs of equal lines take one segment or few


def test_equal_lines_make_one_segment():
    index = fill_middle.fit(np.arange(0, 500_001, 5))
    assert len(index["segments"]) == 1 and index["width"] == 1


def test_every_boundary_is_found_through_the_index(spark):
    rng = random.Random(4)
    texts = ["", "\n", "a", "é\n漢字", "\r\n x\n\n", "𝒳𝒴\n" * 50, "x" * 70_000 + "\n" + "y\n" * 3000]
    texts += ["".join(rng.choice("aé漢𝒳 \n") for _ in range(rng.randrange(400))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("i", fill_middle.rank_index(F.col("text"), 3))
    at = docs.select("doc_id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("i.units"))), "i")
    got = {(r[0], r[1]): r[2] for r in at.select("doc_id", "col", fill_middle.offset_at(F.col("i"), F.col("col"))).collect()}
    want = {}
    for d, text in enumerate(texts):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        for k in range(len(units) + 1):
            want[d, k] = len("".join(units[:k]))
    assert got == want


def brute_force(doc_id, text, seed=7, transformed=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= transformed:
        return len(units), "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("options", [{}, {"seed": 3, "transformed": 40, "suffix_first": 90, "error": 1}])
def test_outputs_equal_brute_force(spark, options):
    rng = random.Random(5)
    texts = ["a<P>b\nc", "<S", "<\nP>\n<M", "<M>", "S>\n<", None, ""]
    texts += ["".join(rng.choice("a<PSM>\né𝒳") for _ in range(rng.randrange(30))) for _ in range(300)]
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = fill_middle.fill_in_middle(docs, **options)
    rows = out.select("doc_id", "text", "fim.*", fill_middle.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    own = {k: v for k, v in options.items() if k != "error"}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_force(r["doc_id"], r["text"], **own)
        assert r["back"] == (r["text"] or "")
    assert {"plain", "spm", "psm"} == {r["form"] for r in rows}


def test_awkward_rows(spark):
    docs = clashing(awkward(spark)).withColumn("_index", F.lit(1))
    out = fill_middle.fill_in_middle(docs)
    assert out.columns == [*docs.columns, "fim"] and out.count() == docs.count()
    assert fill_middle.fill_in_middle(empty(spark)).count() == 0
