from odd import documents, empty, prose
from pyspark.sql import functions as F

from shelfwatch.llm import classifier


def labelled(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        rows.append((i, prose(60, i).replace(" ", "*** ") if bad else prose(60, i)))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_rerun(spark):
    docs, labels = labelled(spark)
    held = F.col("doc_id") % 4 == 2
    w = classifier.train(docs, labels, "quality", ~held)
    assert (w == classifier.train(docs.repartition(5), labels, "quality", ~held)).all()
    got = classifier.score(docs, w).join(labels, "doc_id").where(held).collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = labelled(spark, 120)
    held = F.col("doc_id") % 4 == 2
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (classifier.train(docs, labels, "quality", ~held) == classifier.train(docs, other, "quality", ~held)).all()


def test_odd_inputs(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, 1), (0, 0), (2, 1), (2, 1), (None, 1), (9, 0), (10, None), (99, 1)], "doc_id long, quality int")
    w = classifier.train(docs, labels, "quality", F.lit(True))
    got = classifier.score(docs, w).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert classifier.score(empty(spark), w).count() == 0
    none = classifier.train(docs, labels.limit(0), "quality", F.lit(True))
    assert {r["score"] for r in classifier.score(docs, none).collect()} == {0.5}
