"""The sample from which rules are learned."""

from parcelspark.llm import quality_rules


def test_an_id_of_many_rows_is_one_row_of_the_sample(spark, monkeypatch):
    rows = [(i, f"text number {i}") for i in range(20)] + [(3, f"other text {i}") for i in range(300)] + [(4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(3, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_rules, "learn", lambda rows, bad, order, **options: seen.append((len(order), bad.sum())) or [])
    quality_rules.learn_rules(docs, labels)
    assert seen == [(10, 6)]
    quality_rules.learn_rules(docs, labels, sample_rows=4)
    assert seen[1][0] == 4
