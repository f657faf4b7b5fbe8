"""Bands of a language depend on its own documents, not on how many others there are."""

from pyspark.sql import functions as F

from tagloom.llm import fertility


def measured(spark, others):
    small = spark.range(40).select(F.lit("zz").alias("lang"), (F.lit(2.0) + F.col("id") / 400).alias("c"))
    large = spark.range(others).select(F.lit("en").alias("lang"), (F.lit(4.0) + F.col("id") % 40 / 400).alias("c"))
    return small.unionByName(large).select("lang", F.struct(
        F.lit(100).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("script"), F.col("c").alias("chars_per_token"),
        F.lit(0.0).alias("byte_share"), F.lit(0.9).alias("entropy")).alias("__m"))


def test_a_small_language_has_the_same_bands_beside_a_large_one(spark):
    few, many = (sorted(map(tuple, fertility.bands(measured(spark, n)).filter("_band_group = 'zz'").collect())) for n in (100, 60000))
    assert few == many and {r[1] for r in many} == {-1, 13}
