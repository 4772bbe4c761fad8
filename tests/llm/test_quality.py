import random

from quern.llm import quality as Q
from tests.llm.conftest import made, sentences


def labelled(spark, n=400):
    rng = random.Random(9)
    good = sentences(3, n, 40, 300)
    docs, labels = [], []
    for i in range(n):
        if i % 3:
            docs.append((i, good[i], "en", "s"))
        else:
            docs.append((i, " ".join(f"{rng.choice(['BUY', 'NOW', 'CLICK', 'WIN'])}!!{rng.randint(0, 99)}$$" for _ in range(rng.randint(5, 80))), "en", "s"))
        labels.append((i, int(i % 3 > 0), 0))
    return made(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, awkward, empty):
    docs, labels = labelled(spark)
    model = Q.fit(docs, labels)
    got = [r for r in Q.scored(docs, model).collect() if r["held_out"]]
    right = sum((r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in got)
    assert len(got) > 50 and right >= 0.95 * len(got)
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    rows = Q.scored(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert Q.scored(empty, model).collect() == []


def test_without_labels(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in Q.scored(awkward, Q.fit(awkward, none)).collect()} == {0.5}
    nulls = spark.createDataFrame([(1, None, None), (None, 1, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.5 for r in Q.scored(awkward, Q.fit(awkward, nulls)).collect())


def test_held_out_labels_teach_nothing(spark):
    from pyspark.sql import functions as F

    docs, labels = labelled(spark)
    wrong = labels.withColumn("quality", F.when(Q.held_out(labels["doc_id"]), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Q.sample(docs, wrong) == Q.sample(docs, labels)


def test_scores_against_a_plain_loop(spark, awkward):
    import math

    import zstandard

    docs, labels = labelled(spark)
    model = Q.fit(docs, labels)
    size = lambda part, raw: len(zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False).compress(part))
    for frame in (docs.limit(40), awkward.where("length(text) < 5000 or text is null")):
        texts = [(r["doc_id"], r["text"]) for r in frame.collect()]
        want = []
        for d, t in texts:
            raw = (t or "").encode()
            parts = [raw[a : a + 512] for a in range(0, len(raw), 512)]
            difference = (sum(size(p, model.bad) for p in parts) - sum(size(p, model.good) for p in parts)) / (len(raw) + 16)
            z = model.slope * difference + model.brief * 64 / (64 + len(raw)) + model.offset
            want.append((str(d), round(1 / (1 + math.exp(-max(-50, min(50, z)))), 9)))
        assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in Q.scored(frame, model).collect()) == sorted(want)
