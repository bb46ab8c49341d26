import random

import corpus_pipeline
from corpusql.llm import shingles as N


def jaccard(a, b):
    def cut(text):
        words = (text or "").encode().lower().split()
        size = min(5, len(words))
        return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()

    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def kept(texts):
    """Smallest id of each group that pairs at 0.8 or more join, by comparing all pairs."""
    root = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if root[i] != root[j] and jaccard(a, texts[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return sorted(set(root))


def test_near_dedup_stage_joins_copies_at_jaccard_four_fifths(spark, make):
    from conftest import rows_of

    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    texts = ["", None, " \n", "one two", "One TWO", "one two three four five"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):  # copies on both sides of the border, and copies of copies
            for _ in range(rng.randrange(1, 1 + len(base) // 25)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
    expected = kept(texts)
    assert 40 < len(expected) < len(texts) - 10
    out = corpus_pipeline.near_dedup(spark, make(rows_of(texts)), "")
    assert sorted(r.doc_id for r in out.collect()) == expected


def test_awkward_rows(awkward, nothing):
    found = N.drop_near_copies(awkward)
    rows = awkward.collect()
    assert found.columns == awkward.columns and found.count() == len(kept([r.text for r in rows]))
    assert N.drop_near_copies(nothing).count() == 0


def test_small_tiles_and_parts_lose_nothing(spark, make):
    from conftest import rows_of

    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base, texts = [rng.choice(words) for _ in range(120)], []
    for _ in range(90):  # one group of many candidates, beside others of like length
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(90, 140))))
    expected = kept(texts)
    assert sorted(r.doc_id for r in N.drop_near_copies(make(rows_of(texts)), tile=25, part=1_500).collect()) == expected


def test_fingerprints_of_similar_sets_lie_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    bits = lambda a, b: (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    for n in (5, 10, 45, 300):
        for _ in range(40):
            hashes = rng.integers(0, 2**64, n, dtype=np.uint64)
            similar, other = hashes[: n - n // 5], rng.integers(0, 2**64, n, dtype=np.uint64)
            assert bits(N.wide_print(hashes), N.wide_print(similar)) <= (N.FEW_RADIUS if n <= N.FEW else N.RADIUS) < bits(N.wide_print(hashes), N.wide_print(other))


def test_size_classes_lose_no_pair(spark):
    from pyspark.sql import functions as F

    sizes = [*range(0, 400), 1_000, 1_250, 4_096, 5_120, 10**6, 1_250_000]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", N._size_class(F.col("n")).alias("c")).collect()
    step = {r.n: r.c for r in rows}
    assert all(abs(step[a] - step[b]) <= N.SIZE_STEPS for a in sizes for b in sizes if 0 < a <= b and a >= 0.8 * b)


def test_links_of_a_chain():
    import numpy as np

    sets = [np.arange(i, i + 50, dtype=np.uint64) for i in range(0, 40, 2)]
    assert len(N.exact_links(sets, None)[0]) == len(sets) - 1
    assert len(N.exact_links([sets[0], sets[-1]], None)[0]) == 0
    member, representative = N.exact_links([np.arange(4, dtype=np.uint64)], [np.arange(5, dtype=np.uint64)])
    assert (member.tolist(), representative.tolist()) == ([1], [0])
