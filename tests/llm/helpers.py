"""Small inputs with every odd case, and plain Python forms of the rules."""

import random
import re

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, h1 bigint, batch string, copy int, "
        "t string, node int, component string, key string, runs int, score string, toxic string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWERED))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWERED))


def frame(spark, rows):
    """(doc_id, text, source) rows as documents with extra columns whose names the operators use inside."""
    full = [(i, t, "en", s, len(t or ""), 1, 2, "b", 3, "t", 4, "c", "k", 5, "s", "x") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows(seed=1):
    rng = random.Random(seed)
    base = prose(rng, 80, 500)
    copy = base.split()
    copy[40] = "changed"
    long = prose(rng, 60_000, 5000)
    return [
        (1, base, "a"), (2, " ".join(copy), "a"), (2, " ".join(copy), "a"), (3, None, "b"), (4, "", None), (5, " \t\n ", "b"),
        (None, base, "b"), (None, None, None), (6, "one two three", "a"), (7, "ONE  two\nthree", "a"), (8, long, "c"),
        (9, long + " tail", "c"), (10, "Ünï ÇÖDÉ ſK", "a"), (11, prose(rng, 50), "c"), (12, "x", "c"), (13, "x", "c")]
