"""Documents with nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node int, shard string, slot string, size string, copies string, digest string, mix_luck string"
WORDS = "the of and alpha beta gamma delta omega river stone light cloud winter summer engine paper garden silver".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ly", "ing", str(rng.randrange(60))]) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(f"edit{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def rows() -> list[tuple]:
    base, long = prose(1, 120), prose(2, 9000)
    texts = [
        (1, base), (2, base), (3, edited(base, 3, 0.02)), (4, base.upper()), (5, ""), (6, None), (7, "   \n\t "), (8, "one two three"), (9, "one  two three"), (10, "ONE TWO THREE"),
        (11, long), (12, long[:-40] + " and an end of its own"), (13, prose(5, 60) + "\n" + base), (14, "ünïcode größe 漢字 " * 30), (None, prose(7, 40)), (15, base), (15, base), (16, "x"), (17, edited(base, 8, 0.3)),
        (18, "the the the the the the the the the"), (19, "\x00 nul \x0b bytes here"), (-3, prose(9, 30)),
    ]
    return [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if k % 3 == 0 else len(t or ""), k, k, "a", "b", "c", "d", "e", "f") for k, (i, t) in enumerate(texts)]


def docs(spark, partitions: int = 3):
    return spark.createDataFrame(rows(), SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
