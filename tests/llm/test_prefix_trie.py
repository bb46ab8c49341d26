"""The trie against a dictionary of prefixes, by one bucket and by many rounds."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusql.llm.prefix_trie import build, encode, ends_hashes, graft, prefix_trie, turn_texts
from corpusql.llm.queries import grafted

SCHEMA = "conv_id long, turn long, role string, text string, conv string, Place int, bucket string, `a.b` int, digest string"


def sequences(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    return {c: [x[3] for x in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    rows = set()
    for prefix, members in nodes.items():
        under = [p for p in nodes if p[: len(prefix)] == prefix]
        children = sum(len(p) == len(prefix) + 1 for p in under)
        inner = {p[:-1] for p in nodes if p}
        leaves = sum(p not in inner for p in under)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(prefix))
        parent = min(nodes[prefix[:-1]]) if prefix else None
        rows.add((min(members), len(prefix), parent, len(members), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def found(df):
    rows = [tuple(r)[:8] for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def some():
    """Copies, shared beginnings, turnless rebuilds, ties, nulls and one long conversation with a copy."""
    rng = random.Random(5)
    rows = []
    for c in rng.sample(range(90), 60):
        shared = [("user", "same"), ("assistant", "näher")][: rng.randrange(3)]
        rest = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "long " * 9])) for _ in range(rng.randrange(0 if shared else 1, 5))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(shared + rest)]
    for c in (100, 105, 110, 115):  # copies
        rows += [(c, t, "user", f"t{t}") for t in range(7)]
    for c in (200, 205):
        rows += [(c, t, "user", f"t{t}") for t in range(14)]
    rows += [(300, None, "user", "x"), (300, 1, "user", "y"), (300, 1, "user", "y"), (300, 1, "user", "z"), (None, 1, "user", "nobody"), (301, None, None, None), (-3, 0, "user", "minus")]
    rng.shuffle(rows)
    return [(*r, "x", 1, "b", 2, "d") for r in rows]


@pytest.mark.parametrize(("local_turns", "digit_turns"), [(1 << 18, 8), (6, 3), (0, 5)])
def test_against_prefixes(spark, some, local_turns, digit_turns):
    df = spark.createDataFrame(some, SCHEMA).repartition(5)
    assert found(build(encode(df), local_turns, digit_turns)) == brute(sequences(some))


@pytest.mark.parametrize(("local_turns", "digit_turns"), [(1 << 18, 8), (5, 3)])
def test_rebuilt(spark, some, local_turns, digit_turns):
    some = [r for r in some if r[0] is None or r[0] >= 0]
    df = spark.createDataFrame(some, SCHEMA)
    assert found(build(grafted(df), local_turns, digit_turns)) == brute(rebuilt(sequences(some)))


def test_turnless_and_empty(spark):
    rows = [(6, 0, "user", "x"), (7, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    none = graft(encode(df), F.lit(-1).cast("long"), F.lit(3), 3)
    ends = hashlib.sha256(b"6,7").hexdigest()
    assert found(build(none)) == {(6, 0, None, 2, 0, 1, 0, ends)}
    assert found(prefix_trie(df.limit(0))) == set()


def test_texts_of_nodes(spark):
    df = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, None, "y"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    encoded = encode(df)
    named = build(encoded).join(turn_texts(df, encoded.dictionary), "turn_id", "left").select("depth", "role", "text", "n_convs")
    assert {tuple(r) for r in named.collect()} == {(0, None, None, 2), (1, "user", "x", 2), (2, "", "y", 1)}


def test_hash_of_many_ends(spark):
    ids = [*range(-5, 0), *range(7_000)]
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(3, 1, c) for c in ids] + [(3, 2, 9), (4, 1, 8)], "depth long, node long, conv long").repartition(3)
    whole = hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert {tuple(r) for r in ends_hashes(df).collect()} == {(3, 1, whole), (3, 2, hashlib.sha256(b"9").hexdigest()), (4, 1, hashlib.sha256(b"8").hexdigest())}
