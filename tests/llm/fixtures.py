"""Small tables with the awkward rows that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def rows(seed=7, n=60):
    rng = random.Random(seed)
    vocab = {
        "en": ["the", "and", "house", "river", "walks", "quickly", "over", "stone", "bridge", "morning", "their", "light"],
        "de": ["der", "und", "haus", "fluss", "geht", "schnell", "über", "stein", "brücke", "morgen", "ihre", "licht"],
        "fr": ["le", "et", "maison", "rivière", "marche", "vite", "sur", "pierre", "pont", "matin", "leur", "lumière"],
    }
    out = []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        text = ".\n".join(sentence(rng, 12, vocab[lang]) for _ in range(8)) + "."
        out.append((i if i < 100 else i + 900, text, lang, f"s{i % 2}", len(text)))
    out += [
        (100, None, None, None, None),
        (101, "", "en", "s0", 0),
        (102, "   \n\t ", "en", "s0", 6),
        (103, "12345 !!! 67", "en", None, 12),
        (104, out[0][1], "en", "s0", None),  # an exact copy
        (105, out[0][1].replace("house", "castle", 1), "en", "s0", None),  # a near copy
        (106, "one two three", "en", "s0", 13),
        (107, "One  two\tthree", None, "s0", 14),  # the same three words
        (108, "huge " * 40_000 + "end", "en", "s1", None),
        (None, "no number here but some words all the same", "en", "s1", None),
    ]
    out.append(out[3])  # a repeated row
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def with_clashes(df):
    """Extra columns with names that operators use."""
    names = ["n", "score", "sid", "bits", "word", "part", "kept", "distance", "start", "label", "features", "n_pieces", "sentence_ids", "n_replaced", "lang_pred"]
    for c in names:
        df = df.selectExpr("*", f"'x' AS {c}")
    return df


def folder(spark, path, data=None, benchmark=()):
    """documents and benchmark as Parquet, as queries read them."""
    frame(spark, data).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return str(path)
