"""Preference rows of very long texts and of empty tables."""

from pyspark.sql import functions as F

from tessera.llm.preferences import preference_rows


def test_long_text_and_empty_table(spark):
    schema = "pair_id long, turn int, role string, text string"
    long = "word " * 400_000
    chosen = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "yes")], schema)
    rejected = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "no")], schema)
    row = preference_rows(chosen, rejected).select("n_common", F.length("prompt").alias("n"), "chosen", "rejected").first()
    assert row.n_common == 1 and row.n > len(long) and "yes" in row.chosen and "no" in row.rejected
    for x, y in ((chosen, rejected.where("false")), (chosen.where("false"), rejected), (chosen.where("false"), rejected.where("false"))):
        assert preference_rows(x, y).count() == 0
