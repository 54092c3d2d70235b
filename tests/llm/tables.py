"""A small table with every awkward case: nulls in all columns, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, position double, row_number int, same string, _key string, shard int, media string, score double, component string"
WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("la", "me", "ni", "ro", "su", "ty", "x")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts():
    rng = random.Random(3)
    base = sentence(rng, 120)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (10, 50, 90)]
    far = [" ".join(w if i % 3 else "other" + str(i) for i, w in enumerate(words))]
    long_one = sentence(rng, 9000)
    odd = ["", None, "   ", "word", "two words", "tab\tand\nnew  line ", "ÀÉ ß 漢字 🙂 x", " \x0b\x0c", "a b\x1cc", "Mixed CASE words", "mixed case WORDS"]
    return [base, base, *near, *far, long_one, *odd, *(sentence(rng, rng.randint(5, 60)) for _ in range(25))]


def rows():
    out = [(i, x, ("en", "fr", None)[i % 3], ("s1", "s1", "s2", None)[i % 4], None if x is None else len(x)) for i, x in enumerate(texts())]
    out += [out[0], (None, "no id at all here", None, None, None), (None, None, None, None, None), (7000, out[2][1], "en", "", 3)]
    return [(*r, 1, 0.5, 2, "x", "k", 3, "m", 0.1, "c") for r in out]


def docs(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)
