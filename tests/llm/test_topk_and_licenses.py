import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusql.llm import licenses as L
from corpusql.llm import topk as T

VECTORS = "vec_id long, embedding array<float>, label int, row long, block string, v string"


def brute(rows, k=10, every=100):
    sound = [(i, r) for i, r in enumerate(rows) if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = {i: [math.floor(1024 * float(np.float32(x))) for x in r[1]] for i, r in sound}
    out = []
    for i, r in sound:
        if r[0] % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[i], ints[j], strict=True)), s[0]) for j, s in sound if j != i and len(s[1]) == len(r[1]))
            out += [(r[0], n + 1, v, -s) for n, (s, v) in enumerate(scored[:k])]
    return sorted(out)


def vectors(n, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(0, 0.3, dim)], 0, 5, "b", "v") for i in range(n)]


@pytest.mark.parametrize("blocks", [(1 << 14, 1 << 9), (37, 2)])
def test_topk_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(T, "BLOCK", blocks[0])
    monkeypatch.setattr(T, "QUERY_BLOCK", blocks[1])
    rows = vectors(650)
    rows += [(700, rows[5][1], 0, 5, "b", "v"), (701, rows[5][1], 0, 5, "b", "v"), rows[5], rows[100]]  # ties and repeated rows
    rows += [(800, None, 0, 0, "", ""), (900, [1.0] * 7 + [None], 0, 0, "", ""), (1000, [float("nan")] * 8, 0, 0, "", ""), (None, rows[3][1], 0, 0, "", "")]
    rows += [(1100, [0.5, 0.25], 0, 0, "", ""), (1101, [1.0, -1.0], 0, 0, "", ""), (1200, [], 0, 0, "", ""), (1300, [float("inf")] * 8, 0, 0, "", "")]
    found = T.top_k(spark.createDataFrame(rows, VECTORS))
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_topk_of_few_rows_and_none(spark):
    assert T.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    assert T.top_k(spark.createDataFrame(vectors(1), VECTORS)).count() == 0
    assert sorted(map(tuple, T.top_k(spark.createDataFrame(vectors(4), VECTORS)).collect())) == brute(vectors(4))


def test_large_components_stay_exact():
    big = np.array([[2.0**31, 3.0], [1.0, 2.0]])
    assert T.inner(big, big[0]).tolist() == [2**62 + 9, 2**31 + 6]


def test_bounds_hold_for_close_vectors():
    rng = np.random.default_rng(1)
    items = np.floor(1024 * (rng.normal(0, 0.01, (500, 6)) + 0.3))
    pivots = T.farthest_first(items[:50], 8)
    table = T.distances(items, pivots)
    at, scores = T.best(items[0], table[0], items, table, np.arange(500), np.arange(500) != 0, 10)
    exact = items @ items[0]
    exact[0] = -1
    assert scores.tolist() == sorted(exact, reverse=True)[:10]


FILES = "doc_id long, text string, path string, license string, similarity double, row long"


def scan(spark, rows):
    df = spark.createDataFrame([(i, t, p, "x", 0.0, 1) for i, (p, t) in enumerate(rows)], FILES)
    found = L.license_scan(df, "doc_id", "text", F.col("path"))
    return {r.doc_id: r for r in found.collect()}, found


def brute_similarity(texts, part):
    """Best (similarity, licence) of one sentence, by plain sums over all texts."""
    terms = lambda t: [x for x in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
    n = len(texts)
    df = Counter(x for t in texts for x in set(terms(t)))
    vocabulary = {x for _, notice in L.templates() for x in terms(notice)}
    idf = lambda x: math.log((1 + n) / (1 + (df[x] if x in vocabulary else 0))) + 1
    vector = lambda t: {x: c * idf(x) for x, c in Counter(terms(t)).items()}
    a = vector(part)
    best = (0.0, "")
    for name, notice in L.templates():
        b = vector(notice)
        dot = sum(a[x] * b[x] for x in a.keys() & b.keys())
        score = dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if a else 0.0
        if round(score, 6) > round(best[0], 6) or (round(score, 6) == round(best[0], 6) and name < best[1]):
            best = (score, name)
    return best


def test_own_and_inherited_licences(spark):
    words = " ".join(random.Random(1).choice(["lorem", "ipsum", "dolor"]) for _ in range(50))
    rows = [
        ("/p/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("/p/a/b/code.py", words),
        ("/p/a/COPYING.txt", f"{words}\nReleased under the MIT License.\n{words}"),
        ("/p/a/c/x.py", f"# header\n# This work is licensed under the GNU General Public License, version 3.\n{words}"),
        ("/q/x.py", words),
        ("/p/y.py", None),
        ("/p/z.py", ""),
        (None, "Licensed under CC BY-NC 4.0."),
        (None, words),
        ("/p/a/n.txt", "Licensed under CC BY 4.0."),
        ("/q/mit.py", "mit der und mit " * 30),
        ("top", words),
        ("/p/LICENSE", "Licensed under the Apache License, Version 2.0."),
    ]
    found, _ = scan(spark, rows)
    assert len(found) == len(rows)
    got = {i: (r.license, r.origin, r.from_path) for i, r in found.items()}
    assert got[0] == ("Apache-2.0", "own", "/p/LICENSE") == got[12]
    assert got[3][:2] == ("GPL-3.0", "own") and got[2][:2] == ("MIT", "own")
    assert got[5] == got[6] == ("Apache-2.0", "inherited", "/p/LICENSE")
    assert got[7] == ("CC-BY-NC-4.0", "own", None)
    assert all(got[i] == (None, None, None) for i in (4, 8, 10, 11))
    assert got[1][1] == "inherited" and got[1][2] in ("/p/a/COPYING.txt", "/p/a/n.txt")  # the nearest directory
    texts = [t for _, t in rows]
    for i, part in ((0, texts[0]), (2, "Released under the MIT License."), (3, texts[3].split("\n")[1]), (7, texts[7])):
        similarity, name = brute_similarity(texts, part)
        assert found[i].similarity == pytest.approx(similarity, abs=2e-6) and found[i].license == name


def test_anchors_lose_nothing(spark):
    """Every mixture of template words and others that comes near a template is found."""
    rng = random.Random(7)
    notices = [n for _, n in L.templates()]
    texts = []
    for _ in range(300):
        words = rng.choice(notices).split()
        rng.shuffle(words)
        keep = words[: rng.randrange(1, len(words) + 1)] + ["other"] * rng.randrange(3)
        texts.append(" ".join(keep).replace(".", ""))
    found, _ = scan(spark, [(f"/d{i}/f", t) for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        similarity, name = brute_similarity(texts, t)
        if abs(similarity - L.THRESHOLD) > 1e-5:
            assert (found[i].origin == "own") == (similarity > L.THRESHOLD), t
            assert found[i].origin is None or found[i].license == name


def test_awkward_rows(awkward, nothing):
    path = F.concat_ws("/", F.lit(""), "source", F.col("doc_id").cast("string"))
    assert L.license_scan(awkward, "doc_id", "text", path).count() == awkward.count()
    assert L.license_scan(nothing, "doc_id", "text", path).count() == 0


def test_every_term_weighs_by_its_documents(spark):
    """A common word beside a notice costs little, a rare one much; both as plain sums over all texts say."""
    common = [("/c/f", f"in and licensed under the license word{i}") for i in range(400)]
    parts = ["Licensed under the MIT License in", "Licensed under the MIT License zyx", "This file is licensed under the Apache License, Version 2.0."]
    rows = [*common, *((f"/l{i}/f", t) for i, t in enumerate(parts)), ("/e/f", None), ("/e/g", "")]
    df = spark.createDataFrame([(i, t, p) for i, (p, t) in enumerate(rows)], "doc_id long, text string, path string")
    found = {r.path: r for r in L.license_scan(df, "doc_id", "text", F.col("path"), every_term=True).collect()}
    assert len(found) == 6 and found["/c/f"].license is None
    terms = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    df_of = Counter(x for _, t in rows for x in set(terms(t)))
    vector = lambda t: {x: c * (math.log((1 + len(rows)) / (1 + df_of[x])) + 1) for x, c in Counter(terms(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for i, part in enumerate(parts):
        a = vector(part)
        best = max(sum(w * b.get(x, 0) for x, w in a.items()) / norm(a) / norm(b) for b in (vector(n) for _, n in L.templates()))
        mine = found[f"/l{i}/f"].similarity
        assert (mine is not None) == (best >= L.THRESHOLD) and (mine is None or mine == pytest.approx(best, abs=2e-6))
    assert found["/l0/f"].license == "MIT" and found["/l1/f"].license is None


def test_awkward_rows_with_every_term(awkward, nothing):
    path = F.concat_ws("/", F.lit(""), "source", F.col("doc_id").cast("string"))
    assert L.license_scan(awkward, "doc_id", "text", path, every_term=True).count() == awkward.count()
    assert L.license_scan(nothing, "doc_id", "text", path, every_term=True).count() == 0


def test_bodies_and_spdx_lines(spark):
    """Files with a licence's body license their directory; an SPDX line is the file's own licence."""
    from corpusql.llm.license_texts import BODIES

    words = " ".join(random.Random(2).choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(80))
    rows = []
    for name, body in BODIES.items():
        rows += [(f"/{name}/terms/text", f"Copyright 2020 The Authors\n\n{body}"), (f"/{name}/terms/deep/x.py", words)]
    ids = [name for name, _ in L.NAMES] + ["GPL-2.0-only", "GPL-3.0-or-later"]
    rows += [(f"/spdx{i}/x.py", f"# SPDX-License-Identifier: {name}\n{words}") for i, name in enumerate(ids)]
    for every in (False, True):
        df = spark.createDataFrame([(i, t, p) for i, (p, t) in enumerate(rows)], "doc_id long, text string, path string")
        found = {r.path: r for r in L.license_scan(df, "doc_id", "text", F.col("path"), every_term=every).collect()}
        for name in BODIES:
            assert (found[f"/{name}/terms/text"].license, found[f"/{name}/terms/text"].origin) == (name, "own")
            assert (found[f"/{name}/terms/deep/x.py"].license, found[f"/{name}/terms/deep/x.py"].origin) == (name, "inherited")
        for i, name in enumerate(ids):
            assert found[f"/spdx{i}/x.py"].license == name.removesuffix("-only").removesuffix("-or-later")
