"""What the factorization machine learns from."""

import random
import zlib

from pyspark.sql import functions as F

from millrace.llm import toxicity


def test_scores_do_not_follow_the_cap_of_the_sample(spark, monkeypatch):
    rng = random.Random(2)
    data = [(k, int(k % 10 == 0), " ".join(rng.choice("abcdefgh") * 3 for _ in range(6))) for k in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, toxic int, text string")
    mean = {}
    for most in (12_000, 150):
        monkeypatch.setattr(toxicity, "SAMPLE", most)
        mean[most] = toxicity.score_toxicity(docs, docs.select("doc_id", "toxic")).agg(F.avg("score")).first()[0]
    assert abs(mean[12_000] - 0.1) < 0.04 and abs(mean[150] - 0.1) < 0.04, mean


def test_pairs_without_effects_of_their_parts(spark):
    """Toxic exactly when both words are there or neither; and a group mention, equally common in both classes, beside an insult."""
    rng = random.Random(5)
    data = []
    for k in range(6000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = " ".join(["filler", *["insultword"] * a, *["groupname"] * b, *(rng.choice("abcdefghijklmnop") * 4 for _ in range(5))])
        data.append((k, int(a == b), text))
    docs = spark.createDataFrame(data, "doc_id long, toxic int, text string")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, docs.select("doc_id", "toxic")).collect()}
    held = [(score[k], toxic) for k, toxic, _ in data if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((s > 0.9) if toxic else (s < 0.1) for s, toxic in held) >= 0.99 * len(held)


def test_repeated_rows_are_learned_once(spark):
    data = [(k, int(k % 10 == 0), "word" + " bad" * (k % 10 == 0)) for k in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, toxic int, text string")
    labels = docs.select("doc_id", "toxic")
    repeated = docs.unionByName(docs.filter("doc_id = 3").crossJoin(spark.range(5000)).drop("id"))
    one, more = ({(r.doc_id, r.score) for r in toxicity.score_toxicity(d, labels).collect()} for d in (docs, repeated))
    assert one == more
