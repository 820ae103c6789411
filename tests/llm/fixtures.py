"""Small tables with the awkward cases every operator must handle, and plain reference versions."""
import random
import re

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "doc_id long, text string, row long, entry long, part int, n long, hash long, key long, lang string"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(texts, first=1):
    """(doc_id, text) pairs as rows with extra columns whose names clash with those the operators use inside."""
    return [(i, t, 7, 7, 7, 7, 7, 7, "xx") for i, t in texts]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def awkward():
    """Nulls, empty, white space only, repeated rows, repeated ids, null ids, a long text, ties."""
    rng = random.Random(4)
    base = sentence(rng, 120)
    long = sentence(rng, 30_000)
    return [
        (1, base), (2, base), (3, base.replace(" ", "  ")), (3, base.replace(" ", "  ")), (4, None), (5, ""), (6, " \t\n"), (None, base), (None, None),
        (7, sentence(rng, 80)), (7, sentence(rng, 80)), (8, "Zürich ☃ \U0001f600 end"), (9, long), (10, long + " tail"), (11, "one"), (12, "ONE"),
        (13, base.upper()), (14, "x" * 5000), (15, "\n\n\n"), (16, base + "\n" + sentence(rng, 60)),
    ]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, size=5):
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))
