import pytest
from pyspark.sql import functions as F

#: Null, empty and white texts, ties, repeated rows, long texts, odd characters; an extra column with a clashing name.
ODD = [
    (None, "a text without an id " * 20, "en", "s1", 1), (1, None, "en", "s1", 2), (2, "", "en", None, 3), (3, "  \n\t ", "de", "s2", 4), (4, "one", "de", "s2", 5), (5, "one", "de", "s2", 5),
    (6, "Zwölf große Boxkämpfer 😀 jagen\x1cViktor " * 8, "de", "s3", 6), (6, "Zwölf große Boxkämpfer 😀 jagen\x1cViktor " * 8, "de", "s3", 6), (7, "word " * 30_000, "en", "s1", 7), (8, "x" * 40_000, "en", "s1", 8),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").withColumn("size", F.lit("clash")).withColumn("counts", F.lit(1)).withColumn("n", F.lit(0))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id = -1")


@pytest.fixture(scope="session")
def prose(spark):
    """400 documents of random words, with exact copies, near copies, copies of passages, junk and marked words."""
    import random

    r = random.Random(11)
    bag = ["".join(r.choice("aeioubdgklmnrst") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(bag) for _ in range(r.randint(60, 160))]
        bad = toxic = 0
        if i % 10 == 3:
            words = [w.upper() + "!!" for w in words]
            bad = 1
        elif i % 10 == 6:
            words = [w for w in words[:8] for _ in range(12)]
            bad = 1
        elif i % 10 == 9:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grimsnark", "grimsnarker", "vileblat"]))
            toxic = 1
        if i % 20 == 5:
            words = rows[i - 1][1].split()
        elif i % 20 == 8:
            words = rows[i - 1][1].split()
            words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words), "en", f"src{i % 4 if i % 3 else 0}", 0))
        labels.append((i, 1 - bad, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()
