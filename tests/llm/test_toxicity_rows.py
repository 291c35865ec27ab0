import random

from pyspark.sql import functions as F

from tidemark.llm import toxicity


def test_repeated_ids_are_counted_not_multiplied(spark, monkeypatch):
    """6 000 rows of one id and text, and 300 of another id with different texts: the classifier sees each text once."""
    rng = random.Random(3)
    calm = "river stone window garden letter table morning paper".split()
    text = lambda i: " ".join(rng.choices(calm, k=20)) + (" you stupid idiot, worthless trash" if i % 8 == 0 else "")
    rows = [(i, text(i)) for i in range(400)]
    rows += [(8, rows[8][1])] * 6000 + [(9, f"{rows[9][1]} {k}") for k in range(300)] + [(None, "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 400, 2)] + [(8, 0), (9, 0), (9, None)], "doc_id long, toxic int")
    seen, train = [], toxicity.train

    def counted(chosen, x, p, weight, **more):
        seen.append((len(x), float(weight.sum())))
        return train(chosen, x, p, weight, **more)

    monkeypatch.setattr(toxicity, "train", counted)
    model = toxicity.fit(docs, labels, F.lit(True))
    n, weight = seen[0]
    assert n <= 400 + 300 and 6000 < weight <= len(rows)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).where("doc_id < 400").dropDuplicates(["doc_id"]).collect()}
    assert min(got[i] for i in range(0, 400, 8)) > 0.5 > max(got[i] for i in range(400) if i % 8)
