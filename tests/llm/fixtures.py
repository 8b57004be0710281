"""Documents with the cases that every operator must stand."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, words: int, alphabet: str = "aeioustrnldé") -> str:
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 8))) for _ in range(200)]
    out = []
    for i in range(words):
        out.append(draw.choice(vocabulary) + (".\n" if i % 15 == 14 else ""))
    return " ".join(out)


def edge_rows() -> list[tuple]:
    """Null and empty texts, white space, a null id, a repeated row, copies, near copies, and a very long text."""
    base = prose(1, 160)
    near = base.split(" ")
    near[80] = "changed"
    shared = "This line of more than forty code points is shared by many documents É"
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", None, 0),
        (3, " \t\n\x0b\x0c\r ", None, "a", 7),
        (None, "a text without an id", "en", "a", 20),
        (4, base, "en", "a", len(base)),
        (4, base, "en", "a", len(base)),
        (5, base, "fr", "b", len(base)),
        (6, " ".join(near), "en", "a", 1),
        (7, prose(2, 30_000), "de", "a", 1),
        (8, "a" * 5_000, "xx", "a", 5_000),
        (9, "mail me@ex-ample.org, +1 (415) 555-2671 or 4111 1111 1111 1111 from 10.0.0.255", "en", "a", 1),
        (10, "<|endoftext|> Don't 日本語 ﬁ İstanbul ΣΑΣ 🙂", "ja", "a", 1),
    ]
    rows += [(20 + i, prose(50 + i, 20) + "\n  " + shared.upper().replace("É", "É") + "\t\n" + shared, "en", "a", 1) for i in range(6)]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(edge_rows() if rows is None else rows, COLUMNS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def clashing(df):
    """With columns that bear names which operators use inside or return."""
    from pyspark.sql import functions as F

    names = ["g", "h1", "n", "size", "shard", "kept", "fp", "stratum", "n_words", "score", "items", "t1", "place", "id", "word"]
    return df.withColumns({name: F.lit("x") for name in names})


def rows_of(df, *keys):
    return sorted((tuple(r[k] for k in keys) if keys else tuple(r) for r in df.collect()), key=repr)
