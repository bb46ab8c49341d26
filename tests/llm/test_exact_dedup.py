import hashlib
import string
from collections import defaultdict

from corpusql.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(LOWER)].append(r.doc_id)
    return groups


def test_groups_sizes_and_digests(awkward):
    rows = awkward.collect()
    groups = brute(rows)
    found = exact_duplicates(awkward).collect()
    assert len(found) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in found:
        ids = by_digest[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}  # one row of each group, whatever repeats


def test_only_ascii_letters_are_lowered(make):
    from conftest import rows_of

    found = {r.doc_id: r for r in exact_duplicates(make(rows_of(["É a", "é a", "É A"]))).collect()}
    assert found[0].keep_id == 2 and found[1].keep_id == 1 and found[1].group_size == 1


def test_a_full_filter_changes_nothing(make):
    from conftest import rows_of

    texts = [f"text {i % 700}" for i in range(1_000)]
    df = make(rows_of(texts))
    small = exact_duplicates(df, broadcast_bits=1).select("doc_id", "keep_id", "group_size", "kept").collect()
    large = exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(small) == sorted(large)
    assert sum(r.kept for r in large) == 700


def test_most_single_rows_pass_the_filter(spark):
    from pyspark.sql import functions as F

    from corpusql.llm import exact_dedup as X

    df = spark.range(2_000).select(F.concat(F.lit("t"), F.col("id")).alias("key"))
    blocks = X._blocks(2_000)
    probed = X.with_suspects(df, F.col("key"), X.repeated_bits(F.col("key"), df, blocks), blocks, "s")
    assert probed.filter("s").count() < 100


def test_rows_stay_whole(awkward):
    kept = drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    groups = brute(awkward.collect())
    assert len(rows) == len(groups)
    for r in rows:
        ids = groups[(r.text or "").translate(LOWER)]
        assert r.doc_id == max((i for i in ids if i is not None), default=None)


def test_empty_table(nothing):
    assert exact_duplicates(nothing).count() == 0
    assert drop_exact_duplicates(nothing).count() == 0


def test_a_filter_beyond_the_bound_is_met_by_a_join(spark):
    from corpusql.llm import exact_dedup as X

    from pyspark.sql import functions as F

    df = spark.range(3_000).select((F.col("id") % 2_500).cast("string").alias("key"))
    blocks = X._blocks(3_000)
    found = X.with_suspects(df, F.col("key"), X.repeated_bits(F.col("key"), df, blocks), blocks, "s", broadcast_bits=1)
    # 500 keys come twice; of the 2,000 others few are suspected, though nothing is broadcast.
    assert 1_000 <= found.filter("s").count() < 1_100


def _shuffled(plan):
    """The columns that exchanges of the executed plan deal out, broadcasts not counted."""
    return [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]


def test_texts_never_move_at_any_size(spark, make, tmp_path):
    from conftest import rows_of

    texts = [f"text {i % 700}" for i in range(1_000)] + [None, ""]
    make(rows_of(texts)).repartition(7).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    whole = drop_exact_duplicates(df)
    # Neither filter nor marks fit a broadcast: the filter is joined to digests, files are taken in slices.
    sliced = drop_exact_duplicates(df, broadcast_bits=1, mark_blocks=2)
    for kept in (whole, sliced):
        assert kept.columns == df.columns
        assert not _shuffled(kept._jdf.queryExecution().executedPlan().toString())
        assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i in range(300, 1_000)] + [1_001])
    # Every slice has its own scan, and each of the seven files stands in one of them alone.
    scans = [line for line in sliced._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line and "text#" in line]
    assert len(scans) > 1 and sliced.rdd.getNumPartitions() <= 7


def test_rows_that_are_not_a_files_own(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    # One row of the file becomes three, which share its place; a union has no places; other formats neither.
    copies = table.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    spread = copies.select((F.col("doc_id") * 3 + F.col("copy")).alias("doc_id"), F.concat("text", F.col("doc_id").cast("string")).alias("text"))
    assert sorted(r.doc_id for r in drop_exact_duplicates(spread).collect()) == list(range(2, 150, 3))
    assert [r.doc_id for r in drop_exact_duplicates(table.union(table)).collect()] == [49]
    table.write.json(str(tmp_path / "j"))
    assert [r.doc_id for r in drop_exact_duplicates(spark.read.schema("doc_id long, text string").json(str(tmp_path / "j"))).collect()] == [49]


def test_marked_rows(make, spark):
    from conftest import rows_of
    from pyspark.sql import functions as F

    from corpusql.llm import row_marks as M
    from corpusql.llm import scratch

    df = scratch.table(make(rows_of([f"t{i}" for i in range(400)])).repartition(9).withColumn("nth", F.monotonically_increasing_id()), "rows")
    gone = scratch.table(df.filter("doc_id % 7 = 0").select(F.col("nth").alias("k")), "gone")
    for blocks in (1, 3, M.BLOCKS):
        left = M.without_rows(df, "nth", gone, blocks)
        assert left.columns == df.columns
        assert sorted(r.doc_id for r in left.collect()) == [i for i in range(400) if i % 7]
    assert M.without_rows(df, "nth", gone.limit(0)).count() == 400
    assert M.without_rows(df.limit(0), "nth", gone).count() == 0
