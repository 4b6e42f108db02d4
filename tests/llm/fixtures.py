"""Small hostile tables shared by the tests."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, score double"


def rows(texts):
    return [(i, t, "en", "s", len(t or ""), 5, 0.5) for i, t in enumerate(texts)]


def frame(spark, texts):
    """Documents with extra columns of clashing names."""
    return spark.createDataFrame(rows(texts), DOC_SCHEMA)


def hostile(seed=1, n=60):
    """Null, empty, blank, long, repeated and overlapping texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "Ünï", "a,b", "😀x"]
    out = [None, "", "  \n\t ", "one", "a b", "a b c", "é é é é"]
    passages = [" ".join(rng.choices(words, k=30)) for _ in range(4)]
    for _ in range(n):
        t = " ".join(rng.choices(words, k=rng.randrange(0, 60)))
        if rng.random() < 0.6:
            t += rng.choice(["", " ", "\n"]) + rng.choice(passages)
        if rng.random() < 0.3:
            t += "  " + " ".join(rng.choices(words, k=20))
        out.append(t)
    out += out[7:17]
    out.append(" ".join(rng.choices(words, k=6000)) + " " + passages[0])
    return out
