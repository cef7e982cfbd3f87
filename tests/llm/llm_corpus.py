"""Small corpora with awkward rows: nulls, empty and very long texts, repeated rows, further columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, bucket int, mix_copy string, score string"


def words(rng, n, size=6):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, size))) for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(40)]
    passage = words(rng, 40)
    texts += [f"{words(rng, 15)} {passage} {words(rng, 9)}" for _ in range(12)]
    texts += [texts[3], texts[3] + " ", "\t" + texts[4].replace(" ", "\n"), texts[41], texts[41]]
    texts += [texts[0] + " " + words(rng, 1) for _ in range(3)]
    texts += ["", None, " \n ", None, "x", "é " * 30, words(rng, 30_000), "a" * 200_000, "of " * 400, "Ünï code x"]
    out = [(k, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None])) for k, t in enumerate(texts)]
    rng.shuffle(out)
    out += [out[5], out[5], (None, texts[7], "en", "s0"), (None, "quite another text", None, None)]
    return [(i, t, lang, s, None if t is None else len(t), "k", 1, "m", "sc") for i, t, lang, s in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
