"""The labelled sample is filled from ids that the input has, long texts among them."""

from beaconry.llm import sampling


def test_sample_is_filled_from_ids_that_the_input_has(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(4_000)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, "text") for k in range(3_900, 4_000)], "doc_id long, text string")
    rows = sampling.labelled_sample(docs, labels, "toxic", 20, 1_000, ["text"])
    assert sorted(r.label for r in rows) == [0] * 20 + [1] * 20


def test_long_texts_take_part_within_the_characters_of_their_label(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, "word " * 6_000 if k % 2 else "text") for k in range(40)], "doc_id long, text string")
    rows = sampling.labelled_sample(docs, labels, "toxic", 20, 95_000, ["text"])
    assert {len(r.text) for r in rows} == {4, 30_000}
    assert 0 < sum(r.label for r in rows) <= 3
