"""SimHash links and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessella.llm import simhash
from tessella.llm.graph import components

from .conftest import invented


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def plain_components(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    keys = list(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_fingerprints(docs):
    for r in docs.collect():
        assert simhash.fingerprint((r.text or "").encode()) & simhash.ALL == plain_fingerprint(r.text)


def near(fps):
    r = random.Random(1)
    out = list(fps)
    for f in fps:
        for _ in range(r.choice([0, 0, 1, 5])):
            g = f
            for _ in range(r.choice([1, 2, 3, 4, 5])):
                g ^= 1 << r.randrange(64)
            out.append(g)
    return out


@pytest.mark.parametrize("limit", [1024, 3])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "FILE", limit)
    r = random.Random(2)
    fps = sorted({simhash.signed(f) for f in [*near([r.getrandbits(64) for _ in range(150)]), *near([0, 0, 1, simhash.ALL])]})
    wanted = plain_components(fps, lambda a, b: bin((a ^ b) & simhash.ALL).count("1") <= 3)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert all(bin((e.a ^ e.b) & simhash.ALL).count("1") <= 64 for e in links.collect())
    found = {f: f for f in fps} | {c.node: c.component for c in components(links).collect()}
    assert found == wanted


def test_last_files_are_bounded():
    path = 0
    for level in (20, 20, 20):
        path = path * 21 + level
    assert bin(simhash.mask_of(path)).count("1") >= 55


def test_files_hold_every_near_pair():
    r = random.Random(4)
    for _ in range(200):
        f = r.getrandbits(64)
        g = f
        for _ in range(3):
            g ^= 1 << r.randrange(64)
        assert any(f & m == g & m for m in simhash.FIRST)
    assert len(simhash.FIRST) == 20 and np.bitwise_or.reduce(np.array(simhash.FIRST, np.uint64)) == simhash.ALL


def test_near_duplicates(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(500, invented(5, 150) + " tail"), (501, invented(5, 150))]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {plain_fingerprint(t) for _, t in rows}
    comp = plain_components(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for i, t in rows:
        c = comp[plain_fingerprint(t)]
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    wanted = Counter((i, f"{plain_fingerprint(t):016x}", least[comp[plain_fingerprint(t)]]) for i, t in rows)
    assert Counter(tuple(r) for r in simhash.near_duplicates(extra).collect()) == wanted
    assert simhash.near_duplicates(no_docs).count() == 0

    kept = simhash.keep_one(extra).collect()
    assert len(kept) == len(least)
    assert Counter(r.doc_id for r in kept) == Counter(least.values())
    assert docs.schema == simhash.keep_one(docs).schema


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (5000, 4999), (4999, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)} | {5000: 4999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
