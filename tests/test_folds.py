import random
from itertools import combinations

import pytest

from markloom.functions import checks
from markloom.operators import folds


def texts(spark, samples):
    return spark.createDataFrame(list(enumerate(samples)), "id int, text string")


def table(rng):
    rows = []
    for _ in range(rng.randrange(1, 7)):
        cells = []
        for _ in range(rng.randrange(1, 5)):
            attrs = "".join(f'{k}="{rng.randrange(1, 4)}" ' for k in ("rowspan", "colspan") if rng.random() < 0.25)
            cells.append(f"{attrs}| x" if attrs else "x")
        mark = rng.choice("|!")
        rows.append(f"{mark} " + f" {mark}{mark} ".join(cells) if rng.random() < 0.8 else "\n".join(f"| {c}" for c in cells))
    head = rng.choice(["{|\n", "{|\n|-\n", "{| class=x\n|+ title\n"])
    return head + rng.choice(["\n|-\n", "\n|- style=y\n"]).join(rows) + "\n|}"


@pytest.mark.parametrize("seed", [1, 2])
def test_off_rows_equal_one_pass(spark, seed):
    rng = random.Random(seed)
    samples = ["", "no table", "{|\n|}", "{|\n{|\n| a\n|}\n|}", "{|\n| a"] + ["lead\n\n" * rng.randrange(3) + table(rng) + "\nmid\n" + table(rng) for _ in range(150)]
    got = {}
    for r in folds.off_rows(texts(spark, [*samples, None])).orderBy("id", "at").collect():
        got.setdefault(r.id, []).append((r.line, f"row of {r.width} columns where {r.usual} are usual"))
    want = {i: [(f[3], f[1]) for f in found] for i, t in enumerate(samples) if (found := checks.table_findings(t))}
    assert got == want and len(want) > 10


def score(s, t):
    if s[1] == t[1]:
        return 3.0
    if t[1].startswith(folds.COMMENT_MARK):
        return 2.0
    common = sum(min(s[2].count(w), t[2].count(w)) for w in set(s[2]))
    share = 2 * common / (len(s[2]) + len(t[2])) if s[2] else 0.0
    near = max(0.0, 1 - abs(s[0] - t[0]) / folds.FAR)
    return 0.0 if share < folds.LEAST_ALIKE and near <= 0 else 1 + share + near


def best_sum(ss, ts):
    best = 0.0
    for k in range(min(len(ss), len(ts)) + 1):
        for a in combinations(ss, k):
            for b in combinations(ts, k):
                own = [score(x, y) for x, y in zip(a, b, strict=True)]
                if all(own):
                    best = max(best, sum(own))
    return best


def commented(rng, n):
    bodies = ["keep 1990", "see Paris", "x", "Nga en.wiki: a", "http://a.b c", "{{t}} [[l]]", "note"]
    return " ".join(rng.choices(["word", "and\n", "more text here"], k=rng.randrange(6)) + [y for _ in range(n) for y in (f"<!-- {rng.choice(bodies)} -->", *rng.choices(["a", "b c", "\n"], k=rng.randrange(4)))])


def test_matchings_have_the_largest_sum(spark):
    rng = random.Random(3)
    source = [commented(rng, rng.randrange(0, 6)) for _ in range(60)]
    made = [commented(rng, rng.randrange(0, 6)) for _ in range(60)]
    rows = {k: {} for k in "st"}
    for k, side in (("s", source), ("t", made)):
        for r in folds.comments(texts(spark, side)).orderBy("id", "n").collect():
            rows[k].setdefault(r.id, []).append((r.place, r.body, list(r.words)))
            assert side[r.id][r.s : r.e].startswith("<!--") and side[r.id][r.s : r.e].endswith("-->")
    got = {}
    for r in folds.aligned(texts(spark, source), texts(spark, made)).collect():
        got.setdefault(r.id, []).append((r.i, r.n))
    for i in range(60):
        ss, ts = rows["s"].get(i, []), rows["t"].get(i, [])
        pairs = sorted(got.get(i, []))
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:], strict=False))
        assert sum(score(ss[a], ts[b]) for a, b in pairs) == pytest.approx(best_sum(ss, ts))


def test_comments_are_settled(spark):
    source = ["a <!-- keep --> b", "a", "<!-- one -->"]
    made = ["a <!-- keep --> b\n<!-- new thing -->\nc", "x <!-- y --> z", None]
    got = {r.id: (r.text, r.n) for r in folds.settled_comments(texts(spark, source), texts(spark, made)).collect()}
    assert got[0] == ("a <!-- Nga en.wiki: keep --> b\nc", 1)
    assert got[1] == ("x  z", 1) and got[2] == (None, 0)
    again = folds.settled_comments(texts(spark, source[:1]), texts(spark, [got[0][0]])).first()
    assert (again.text, again.n) == (got[0][0], 0)
