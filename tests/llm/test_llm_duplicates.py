"""Verified near duplicates: equal to brute force over whole tables, whatever the shape of the groups."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tidemark.llm import verified
from tidemark.llm.queries import op12_duplicates

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Rows of (doc_id, text); ids may repeat or be null."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for members in by.values():
        for i in members:
            for j in members:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 85 * len(sets[i] | sets[j]):
                        a, b = root(i), root(j)
                        up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d is not None and c == d))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_whole_table_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(op12_duplicates(spark, SF)) == brute(rows)


def edited(rng, words, share):
    out = list(words)
    for _ in range(round(share * len(out))):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("limits", ["whole", "small"])
def test_groups_of_near_copies(spark, monkeypatch, limits):
    """A group whose copies differ more and more, chains, and copies; also with so small limits that all ways are gone."""
    if limits == "small":
        for name, value in (("CROWD", 16), ("BLOCK_ROWS", 8)):
            monkeypatch.setattr(verified, name, value)
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [" ".join(base)] * 3 + [edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03, 0.06])) for _ in range(120)]
    chain = list(base[:60])
    for i in range(40):
        chain[(7 * i) % 60] = f"c{i}"
        texts.append(" ".join(chain))
    texts += [" ".join(f"x{rng.randrange(50)}" for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert got(verified.duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [(1, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one TWO"), (None, "one two"), (None, "lone words of a row without id"), (5, "one"), (6, "É é A"), (7, "é é a")]
    rows += [(9, long), (8, long + " end"), (9, "one two three four five six"), (9, "one two three four five six"), (10, "a b c"), (11, "a b c"), (-4, "ONE TWO")]
    docs = spark.createDataFrame([(d, t, "x", 1, 2, "y") for d, t in rows], "doc_id bigint, text string, digest string, n_shingles int, group int, kept string")
    assert got(verified.duplicates(docs)) == brute(rows)
    assert verified.duplicates(docs.limit(0)).collect() == []


def test_agreements_follow_the_posterior():
    """A pair is dropped only where the beta posterior says so, checked by integration; and pairs at the threshold survive."""
    needed = verified.least_agreements(0.85, 1e-4)
    c = 0.85 + 0.15 / 256
    x = (np.arange(200_000) + 0.5) / 200_000
    for n, m in needed:
        for agree, dropped in ((m - 1, True), (m, False)):
            density = x**agree * (1 - x) ** (n - agree)
            assert (density[x > c].sum() / density.sum() < 1e-4) == dropped
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (20_000, 128)).astype(np.uint8)
    b = np.where(rng.random(a.shape) < 0.85, a, rng.integers(0, 256, a.shape)).astype(np.uint8)
    assert len(verified.survivors(a, b, verified.least_agreements(0.85))) >= 19_990
    assert len(verified.survivors(a, a[::-1].copy(), verified.least_agreements(0.85))) == 0
