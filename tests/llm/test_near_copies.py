"""The Jaccard join on large groups of copies, repeated keys and odd words, against brute force."""

import random

from treeloom.llm import jaccard

from test_llm_ops import brute_components

SCHEMA = "doc_id long, text string"


def test_large_groups_of_near_copies(spark):
    """2,000 edited copies of one text (chains of edits, so that not all are near each other), 300 exact ones, and two
    texts that share a passage with all of them."""
    rng = random.Random(8)
    words = [f"v{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(60)]
    texts, own = {}, list(base)
    for k in range(2000):
        if k % 50 == 0:
            own = list(base)
        own = list(own)
        own[rng.randrange(60)] = rng.choice(words)
        texts[5 + k] = " ".join(own if rng.random() < 0.5 else base[:30] + own[30:])
    texts |= {10_000 + k: " ".join(base) for k in range(300)}
    texts |= {1: " ".join(base[:30] + [rng.choice(words) for _ in range(30)]), 2: " ".join([rng.choice(words) for _ in range(40)] + base[30:])}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(list(texts.items()), SCHEMA).repartition(7)).collect()}
    assert got == brute_components(texts)


def test_repeated_keys_and_odd_words(spark):
    """Rows that repeat a key are rows of their own; words that simple hashes confuse are told apart; other columns may clash in name."""
    morse = [bin(k).count("1") % 2 for k in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in morse) for flip in (0, 1))
    rest = "one two three four five six seven eight nine ten"
    rows = [(1, f"{a} {rest}", 0), (2, f"{b} " + " ".join(reversed(rest.split())), 0), (5, "x y z u v w", 1), (3, "x y z u v w", 1), (5, "quite another text is here now", 2), (5, "quite another text is here now", 2), (5, "", 3), (None, "x y z u v w", 3), (9, a, 4), (10, b, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").repartition(3)
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.join(docs).collect()))
    assert got == [(0, 2, 0), (1, 7, 1), (2, 7, 2), (3, 2, 3), (5, 0, 5), (5, 2, 3), (5, 2, 5), (5, 2, 5), (9, 1, 9), (10, 1, 10)]
    kept = sorted((r["doc_id"] or 0, r["text"], r["node"]) for r in jaccard.keep_first(docs).collect())
    assert kept == sorted([(0, "x y z u v w", 3), (1, rows[0][1], 0), (2, rows[1][1], 0), (3, "x y z u v w", 1), (5, "quite another text is here now", 2), (5, "", 3), (9, a, 4), (10, b, 4)])


def test_squares_of_large_groups():
    """Groups beyond SIDE are dealt in squares: every pair meets exactly once."""
    import numpy as np

    n, side = 23, 5
    stretches = range(0, n, side)
    seen = []
    for i, a in enumerate(stretches):
        for b in list(stretches)[i:]:
            members = list(range(a, min(a + side, n))) + ([] if a == b else list(range(b, min(b + side, n))))
            sides = np.array([0] * len(range(a, min(a + side, n))) + ([] if a == b else [1] * len(range(b, min(b + side, n)))))
            same = np.full(len(members), 6)
            sketch = [jaccard.bit_sketch(np.arange(6).astype(np.uint64))] * len(members)
            seen += [tuple(sorted((members[x], members[y]))) for x, others, _ in jaccard.near_pairs(same, np.arange(len(members)), sketch, 80, sides) for y in others.tolist()]
    assert sorted(seen) == [(i, j) for i in range(n) for j in range(i + 1, n)]


def test_pairs_of_several_groups_are_given_once():
    """Of the groups that both classes are in, only that of the least common mark gives the pair; without one in sight, all do."""
    import numpy as np

    marks = np.zeros((3, jaccard.MARKS), np.int64)
    marks[0, :3], marks[1, :3], marks[2, :2] = (5, 7, 9), (7, 9, 11), (1, 3)
    assert [m for m in (7, 9, 11) if jaccard._once(m, marks, 0, np.array([1]))[0]] == [7]
    assert jaccard._once(9, marks, 0, np.array([2, 1])).tolist() == [True, False]


def test_forest_connects_what_all_pairs_connect():
    import numpy as np

    a, b, differ = np.array([0, 0, 1, 2, 3]), np.array([1, 2, 2, 3, 4]), np.array([3, 1, 2, 5, 0])
    assert sorted(jaccard._forest(a, b, differ, np.array([10, 11, 12, 12, 13])).tolist()) == [1, 2, 4]
