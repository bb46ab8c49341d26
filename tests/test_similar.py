"""Similar texts against comparing every pair."""

import itertools
import random

import numpy as np
import pytest

from corpusql.operators import similar as S


def brute(texts, threshold):
    sets = {i: frozenset((t or "").lower().split()) for i, t in texts}
    cls = {}
    for i in sorted(sets):
        cls.setdefault(sets[i] or i, i)
    pairs = {}
    for (a, i), (b, j) in itertools.combinations(sorted((i, s) for s, i in cls.items() if isinstance(s, frozenset)), 2):
        value = len(i & j) / len(i | j)
        if value >= threshold:
            pairs[a, b] = round(value, 6)
    links = {i: sum(k != i and bool(sets[i]) and bool(sets[k]) and len(sets[i] & sets[k]) / len(sets[i] | sets[k]) >= threshold for k in sets) for i in sets}
    return pairs, {i: (cls[s or i], links[i]) for i, s in sets.items()}


def some(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 10
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 10, 30]))] for _ in range(n // 4)]
    texts = []
    for i in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rng.shuffle(own)
        texts.append((i, " ".join(own)))
    return [*texts, (n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "THE The the"), (n + 4, "the")]


@pytest.mark.parametrize(("threshold", "seed"), [(0.8, 1), (0.5, 2), (1.0, 3)])
def test_against_every_pair(spark, monkeypatch, threshold, seed):
    monkeypatch.setattr(S, "FREQUENT_WORDS", 5)
    texts = some(seed)
    df = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id long, text string, n int, word string").repartition(3)
    pairs, counts = brute(texts, threshold)
    assert {(r.doc_a, r.doc_b): r.similarity for r in S.similar_pairs(df, threshold).collect()} == pairs
    assert {r.doc_id: (r.class_id, r.n_links) for r in S.similar_counts(df, threshold).collect()} == counts
    assert pairs or threshold == 1.0


def test_copies_are_one_class(spark):
    df = spark.createDataFrame([(i, "one two three four five") for i in range(500)] + [(900, "one two three four six"), (901, "five four three two one")], "doc_id long, text string")
    assert S.similar_pairs(df, 0.6).collect() == [(0, 900, pytest.approx(4 / 6, abs=1e-6))]
    found = {r.doc_id: (r.class_id, r.n_links) for r in S.similar_counts(df, 0.6).collect()}
    assert found[7] == found[901] == (0, 501) and found[900] == (900, 501)


def test_nothing(spark):
    assert S.similar_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefix_length():
    for n in range(1, 60):
        for threshold in (0.5, 0.8, 1.0):
            assert S.prefix_length(n, threshold) == min(p for p in range(1, n + 2) if n - p + 1 <= -(-round(threshold * 10 * n) // 10))


def test_sketches_differ_no_more_than_sets_and_rule_pairs_out():
    rng = random.Random(4)
    for n in (1, 20, 200):
        one = [f"w{rng.randrange(10_000)}" for _ in range(n)]
        for other in ([*one[: n - n // 10], *(f"v{i}" for i in range(n // 10))], [f"u{i}" for i in range(n)]):
            a, b = set(one), set(other)
            apart = sum(int(x).bit_count() for x in (S.sketch(list(a)) ^ S.sketch(list(b))).view("uint64"))
            assert apart <= len(a ^ b)
    # Two sets of 200 words that share the prefix's word alone are not met.
    assert apart > 400 - 2 * -(-0.8 / 1.8 * 400 // 1)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.95, 1.0])
def test_similar_sets_share_a_signature_in_a_slice_they_differ_little_in(threshold):
    rng = random.Random(5)
    hashed = lambda words: np.array([w * 0x9E3779B97F4A7C15 % 2**64 for w in words], np.uint64)
    met = 0
    for n in [*range(1, 30), 100, 250, 700, 2_000]:
        known = S.ranges(threshold, 2 * n)
        one = rng.sample(range(10**9), n)
        for _ in range(6):
            other = one[rng.randrange(int(n * (1 - threshold)) + 1) :] + rng.sample(range(10**9, 2 * 10**9), rng.randrange(int(n * (1 - threshold) / threshold) + 1))
            a, b = sorted((one, other), key=len)
            if len(set(a) & set(b)) < threshold * len(set(a) | set(b)):
                continue
            at = [next(r.place for r in known if r.top >= len(x)) for x in (a, b)]
            assert at[1] - at[0] in (0, 1)
            (keys, bits), (others, theirs) = (S.signatures(hashed(x), known[at[1]]) for x in (a, b))
            apart = np.bitwise_count((bits ^ theirs).view(np.uint64)).sum(axis=1)
            assert ((keys == others).any(axis=1) & (apart <= known[at[1]].differ)).any()
            met += 1
    assert met > 50


def test_large_sets_of_common_words_are_not_compared(spark, monkeypatch):
    """Sketches of whole sets of a thousand words told nothing, so all pairs that shared a word of their prefixes were written and met as wholes."""
    rng, tables = random.Random(6), []

    def kept(df, write=S.written):
        tables.append(write(df))
        return tables[-1]

    monkeypatch.setattr(S, "written", kept)
    vocabulary = [f"w{i}" for i in range(4_000)]
    texts = [(i, " ".join(rng.sample(vocabulary, 1_000))) for i in range(60)]
    texts += [(100 + i, " ".join([*text.split()[50:], *(f"x{j}" for j in range(40))])) for i, text in texts[:5]]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted((r.doc_a, r.doc_b) for r in S.similar_pairs(df).collect()) == [(i, 100 + i) for i in range(5)]
    assert [t.count() for t in tables if "class_id_a" in t.columns] == [5]


def test_a_common_signature_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRS", 7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        common = " ".join(f"c{i}" for i in range(20))
        df = spark.createDataFrame([(i, f"{common} own{i}") for i in range(23)], "doc_id long, text string")
        assert S.similar_pairs(df).count() == 23 * 22 // 2
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
