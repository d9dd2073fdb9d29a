"""Small frames with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, key string, kept boolean, spans string, part int, seq int, label string, weight double, host string, n long, words string, component long"
EXTRA = (7, "r", "k", True, "s", 1, 2, "l", 0.5, "h", 3, "w", 9)


def words(rng, n, common=0.3):
    return " ".join(rng.choice(["the", "of", "and", "a"]) if rng.random() < common else "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def texts(seed=3):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(60, 120)) for _ in range(12)]
    near = [t.replace(t.split()[30], "changed") for t in base[:4]]
    mixed = [base[0] + "\n" + base[5], base[6][:200] + " éèü " + base[7][100:300], "x" * 30 + base[2][20:90] + "y" * 30]
    odd = ["", None, " ", "one", "one two three", "ß", "…", "\u0000\t\n\r", "a" * 5000, words(rng, 4000), "<|endoftext|> <|im_end|>", "no letters 123 !!!".replace("no letters", "")]
    return base + base[:3] + [base[1]] * 5 + near + mixed + odd


def messy(spark, seed=3):
    """Documents with ids of their own but for two repeated rows and one null id."""
    t = texts(seed)
    rows = [(i, x, None if i % 7 == 0 else ("en", "fr")[i % 2], None if i % 5 == 0 else f"src{i % 3}", None if x is None else len(x), *EXTRA) for i, x in enumerate(t)]
    rows += [rows[2], rows[2], (None, t[0], None, None, None, *[None] * 13)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
