from pyspark.sql import functions as F

from corpusql.llm.samples import labelled_sample, row_hash


def test_a_long_text_costs_only_itself(spark):
    """Whichever row is beyond the bound, all others are in the sample."""
    for long in range(6):
        rows = [(i, "x" * (5_000 if i == long else 10), i % 2) for i in range(6)]
        df = spark.createDataFrame(rows, "id long, text string, label int")
        keys = df.select(row_hash().alias("h"), F.octet_length("text").alias("size"), "label")
        found = labelled_sample(df.select("id", "text"), keys, "label", 100, 1_000)
        assert sorted((r["id"], label) for r, label in found) == [(i, i % 2) for i in range(6) if i != long]


def test_repeated_rows_count_once_and_the_smallest_hashes_are_taken(spark):
    rows = [(i % 900 if i % 3 else None, f"t{i % 900}", int(i % 900 >= 800)) for i in range(4_000)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    keys = df.select(row_hash().alias("h"), F.octet_length("text").alias("size"), "label")
    found = labelled_sample(df.select("id", "text"), keys, "label", 50, 100_000)
    taken = {(r["id"], r["text"]) for r, _ in found}
    assert len(found) == len(taken) == 100
    order = df.select("id", "text", "label", row_hash().alias("h")).distinct().orderBy("h").collect()
    assert taken == {(r.id, r.text) for label in (0, 1) for r in [r for r in order if r.label == label][:50]}
