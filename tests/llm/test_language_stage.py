"""The network, not a letter, decides what the language stage keeps."""

import random

import corpus_pipeline

from millrace.llm import language


def test_junk_with_letters_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = ["12345 67890 !!! a 4711 0815 ???", "%%% ### 7 7 7 7 7 x", "0" * 500 + "q", "=-=-=-=-= [1] (2) {3} ab"]
    clean = docs.filter("doc_id % 4 = 2").count()
    first = docs.agg({"doc_id": "max"}).first()[0] + 1
    other = docs.limit(1).drop("doc_id", "text")
    rows = spark.createDataFrame([(first + k, t) for k, t in enumerate(junk)], "doc_id long, text string").crossJoin(other)
    kept = dict(corpus_pipeline.STAGES)["language"](spark, docs.unionByName(rows.select(docs.columns)), "")
    assert kept.filter(kept.doc_id >= first).count() == 0
    assert kept.filter("doc_id % 4 = 2").count() >= 0.99 * clean > 0


def test_scarce_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 300)
    rng = random.Random(3)
    letters = {"aa": "abcdefg", "bb": "hijklmn", "zz": "opqrstu"}

    def text(lang):
        return " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(20))

    data = [(k, lang, text(lang)) for k, lang in enumerate(["aa"] * 4000 + ["bb"] * 4000 + ["zz"] * 30)]
    docs = spark.createDataFrame(data, "doc_id long, lang string, text string")
    _, wanted, languages = language.sample(docs)
    assert languages == ["aa", "bb", "zz"] and (wanted == 2).sum() > 15 and (wanted < 2).sum() >= 400
    found = language.identify_language(docs.filter("lang = 'zz' or doc_id % 10 = 0")).collect()
    assert sum(r.lang_pred == data[r.doc_id][1] for r in found) >= 0.98 * len(found)
    first = docs.filter("doc_id = 1")
    repeated = docs.unionByName(first.crossJoin(spark.range(3000)).select(docs.columns))
    assert (language.sample(repeated)[1] < 2).sum() >= 400


def test_tables_without_labels_pass(spark):
    rows = [(1, None, "a text"), (2, None, "12 \u00b2 ..."), (3, None, None), (4, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert [r.doc_id for r in language.keep_identified(docs, 0.35, share=0.25).collect()] == [1]
