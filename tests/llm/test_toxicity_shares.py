"""The prior follows the class shares of all labels, however many of each class are sampled."""

import random

from strandframe.llm import toxicity


def test_capped_classes_keep_their_shares(spark, monkeypatch):
    r = random.Random(3)
    bag = ["".join(r.choice("aeioubdgklmnrst") for _ in range(6)) for _ in range(2000)]
    rows, labels = [], []
    for i in range(1000):
        words = [r.choice(bag) for _ in range(30)]
        toxic = int(i % 25 == 0)
        # every toxic text and one in sixteen clean ones: about two in five of those with the word are toxic
        if toxic or i % 16 == 1:
            words.insert(r.randrange(1, 30), "doubtful")
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "MAX_EXAMPLES", 200)
    model = toxicity.fit(docs, marked)
    learning = [y for (i, y), keep in zip(labels, [x.k for x in docs.orderBy("doc_id").select(toxicity.learns(docs.doc_id).alias("k")).collect()]) if keep]
    assert abs(model.prior - sum(learning) / len(learning)) < 1e-9
