"""Small tables with the awkward rows every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, start long, key string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "Delta", "ε", "été", "naïve", "x1", "foo,", "bar."]) + str(rng.randrange(40)) for _ in range(n))


def documents(spark):
    """Null and empty texts, ties, repeated rows, a long text, odd white space and extra columns with clashing names."""
    rng = random.Random(5)
    long = words(rng, 4000)
    passage = "The same passage stands in several texts and is much longer than a hundred bytes, so that it counts as a repeat everywhere. "
    texts = [
        (1, "plain words only", "en", "a"), (2, None, "en", None), (3, "", "de", "b"), (4, "   \t\n ", None, "b"), (5, long, "en", "a"), (6, long, "fr", "c"), (7, long + " tail", "fr", "a"),
        (8, "x " + passage + "one", "en", "a"), (9, "yy " + passage + "two", "en", "b"), (10, passage + passage, "en", "c"), (11, "a" * 400, "en", "a"), (12, " lead  two\n\n next\x0bv\x1ct nb   end ", "es", "d"),
        (13, "it's we'll  don't\r\n<|endoftext|> \U0001f600\U0001f600 \x00 z", "es", "d"), (14, "plain words only", "en", "z"), (15, "plain words onlx", "en", "a"), (15, "plain words only", "en", "a"), (16, "dup row", "en", "a"), (16, "dup row", "en", "a"),
        (17, words(rng, 60), "en", "a"), (-3, words(rng, 55), "de", "b"), (None, "no id here", "en", "a"),
    ]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "clash", 7, "k") for i, t, lang, s in texts], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
