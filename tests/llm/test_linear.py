from pyspark.sql import functions as F

from tallyvane.llm import mixing, toxicity
from tallyvane.llm.linear import sampled, smallest_hashes


def test_samples_are_bounded_in_rows(spark):
    rows = [(1, "same text")] * 300 + [(2, f"text {i}") for i in range(200)] + [(i, "x") for i in range(3, 30)]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = sampled(docs, smallest_hashes(docs, "id", 40, 1), "id", 40).collect()
    assert len(got) == 40 == len(set(got)) and set(got) <= set(docs.collect())
    assert set(got) == set(sampled(docs.repartition(7), smallest_hashes(docs, "id", 40, 1), "id", 40).collect())
    alone = docs.where("id <> 2")
    assert sorted(map(tuple, sampled(alone, smallest_hashes(alone, "id", 40, 1), "id", 40).collect())) == sorted(set(map(tuple, alone.collect())))


def test_fits_see_a_repeated_row_once(spark, monkeypatch):
    seen = []
    keep = lambda module, name: monkeypatch.setattr(module, name, lambda rows, *rest, old=getattr(module, name), **named: seen.append(getattr(rows, "n", None) or len(rows)) or old(rows, *rest, **named))
    keep(mixing, "fit_softmax")
    keep(toxicity, "fit_nnpu")
    docs = spark.createDataFrame([(i, f"words of text {i}") for i in range(20)] + [(1, "words of text 1")] * 100, "doc_id long, text string")
    mixing.posteriors(docs, docs.select("doc_id", F.lit("en").alias("domain")).distinct())
    toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic")).distinct())
    assert seen[0] == 20 and seen[1] <= 20
