from pyspark.sql import functions as F

from pairloom.llm import pii


def test_the_model_learns_from_every_candidate(spark, monkeypatch):
    learned, plain = [], pii.stored
    monkeypatch.setattr(pii, "stored", lambda df: learned.append(plain(df)) or learned[-1])
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("password=x"), F.col("id"), F.lit("yz"))).otherwise(F.concat(F.lit("room "), F.col("id"))).alias("text"),
    )
    assert pii.find_private(docs).count() == 6000
    made = docs.select(*[F.size(pii.candidates(F.col("text"), g, p)).alias(g) for g, p in pii.GENERATORS.items()])
    whole = made.agg(*[F.sum(g).alias(g) for g in pii.GENERATORS]).first().asDict()
    seen = {r["_g"]: r["n"] for r in learned[0].groupBy("_g").agg(F.sum("weight").alias("n")).collect()}
    assert {g: n for g, n in whole.items() if n} == seen and sum(seen.values()) >= 6000
