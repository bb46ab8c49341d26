import random
import re
from collections import defaultdict

from conftest import rows_of

from corpusql.llm.mixing import mix, mixed_rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def water_level(sizes, weights, share=1.5, cap=2.0):
    """Targets by repeated sharing among the sources that are not full."""
    left, open_, target = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = cap * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def check(df):
    rows = df.collect()
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = lambda r: len(WORDS.findall(r.text or ""))
    sizes = [sum(size(r) for r in rows if r.source == n) for n in names]
    target = dict(zip(names, water_level(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    found = mix(df).collect()
    assert len(found) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    by_key = defaultdict(list)
    for r in rows:
        by_key[r.doc_id, size(r)].append(r.source)
        largest[r.source] = max(largest[r.source], size(r))
    for r in found:
        sources = by_key[r.doc_id, r.size]
        assert sources and any(abs(r.target - target[s]) <= 1e-6 * (1 + r.target) for s in sources)
        assert 0 <= r.taken <= 2 * r.size
        source = next(s for s in sources if abs(r.target - target[s]) <= 1e-6 * (1 + r.target))
        taken[source] += r.taken
    for n in names:
        assert abs(taken[n] - target[n]) <= largest[n] + 1e-6, n
    return found


def test_awkward_rows(awkward):
    check(awkward)


def test_many_sources_and_a_hot_one(make):
    rng = random.Random(4)
    texts = [(" ".join(["w"] * int(rng.lognormvariate(3, 1))), "en", rng.choice(["hot", "hot", "a", "b", "é", "z", None])) for _ in range(1_500)]
    df = make(rows_of(texts))
    first = check(df)
    assert sorted(map(str, first)) == sorted(map(str, mix(df.repartition(7)).collect()))  # reruns agree


def test_rows_come_as_often_as_they_are_taken(make):
    texts = [(" ".join(["w"] * (i % 9)), "en", "abcd"[i % 4]) for i in range(300)]
    df = make(rows_of(texts))
    out = mixed_rows(df)
    assert out.columns == df.columns
    want = {r.doc_id: r.n_copies for r in mix(df).collect() if r.n_copies}
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == want


def test_empty_tables(nothing, make):
    assert mix(nothing).count() == 0 and mixed_rows(nothing).count() == 0
    blank = mix(make(rows_of(["", " ", None]))).collect()
    assert [r.taken for r in blank] == [0, 0, 0] and {r.target for r in blank} == {0.0}
