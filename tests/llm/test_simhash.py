import random
import re
import string

import numpy as np
import xxhash

from corpusql.llm import simhash as S
from corpusql.llm.components import components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_print(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=4):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_fingerprints(awkward):
    for r in awkward.select("text").filter("length(text) < 1000 or text is null").collect():
        assert S.fingerprint(r.text or "") == brute_print(r.text)
    long = " ".join(str(random.Random(1).random()) for _ in range(3)) + " Ünï\x0bcode\x85x y"
    assert S.fingerprint(long) == brute_print(long)


def test_components_of_awkward_rows(awkward):
    rows = awkward.collect()
    found = S.near_duplicates(awkward).collect()
    assert len(found) == len(rows)
    roots = brute_groups([S.fingerprint(r.text or "") for r in rows])
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r.doc_id is not None:
            least[root] = min(r.doc_id, least.get(root, r.doc_id))
    expected = sorted(((r.doc_id, f"{S.fingerprint(r.text or ''):016x}", least.get(root)) for r, root in zip(rows, roots, strict=True)), key=str)
    assert sorted(map(tuple, found), key=str) == expected
    kept = S.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(set(roots))
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(least.values())


def test_tiles_find_the_links_of_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 900)).astype(np.uint64))
    prints = np.unique(np.concatenate([base, rng.choice(base, 900) ^ flips]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    for tile in (50, 100_000):  # many tiles, split cells, and one tile alone
        roots = {r.node: r.root for r in components(S.links(df, 4, tile)).collect()}
        mine = {int(x): roots.get(int(x), int(x)) for x in prints.view(np.int64)}
        theirs = brute_groups([int(x) for x in prints])
        pairs = {(a, b) for a, b in zip(mine.values(), theirs, strict=True)}
        assert len(pairs) == len(set(mine.values())) == len(set(theirs))


def test_skipping_loses_no_link():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 700, dtype=np.uint64)
    b = np.concatenate([a[:300] ^ np.uint64(0b1011), rng.integers(0, 2**63, 100, dtype=np.uint64)])
    member, representative = S.linked(a, b, 4, block=16)
    found = {int(x): int(y) for x, y in zip(member, representative, strict=True)}
    groups = brute_groups([int(x) for x in np.concatenate([a, b])])
    assert len(found) == len(a) + len(b) - len(set(groups))


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [201, 301]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(nothing):
    assert S.near_duplicates(nothing).count() == 0
    assert S.drop_near_duplicates(nothing).count() == 0
