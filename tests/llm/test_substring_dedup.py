import hashlib
import random

import pytest

from leadloom.llm import substring_dedup as sd


def brute(rows, window):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5)))
    passages = [[word() for _ in range(rnd.randint(8, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += rnd.choice(passages) if rnd.random() < 0.4 else [word() for _ in range(rnd.randint(0, 40))]
        rows.append((i * 3, "\n ".join(words) if rnd.random() < 0.2 else " ".join(words)))
    rows += [(1000 + i, rows[7][1]) for i in range(5)] + [(-4, rows[9][1]), (2000, ""), (2001, None), (None, rows[7][1]), (2002, "x " * 400), (2003, "x " * 300)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("window", "hot"), [(50, 1000), (10, 1000), (10, 3), (50, 2)])
def test_matches_brute_force(spark, monkeypatch, window, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = corpus(window + hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as place", "2 as spread").repartition(5)
    got = sorted((tuple(r) for r in sd.remove_repeats(df, window=window, digests=True).collect()), key=repr)
    assert got == brute(rows, window)


def test_empty_and_kept_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sd.remove_repeats(none).collect() == []
    one = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, one), (2, "a " + one + " b"), (2, "a " + one + " b")], "doc_id long, text string")
    assert sorted(tuple(r) for r in sd.remove_repeats(df).collect()) == [(1, 60, 0, one), (2, 62, 60, "a b"), (2, 62, 60, "a b")]


def test_estimates_hold_when_the_second_pass_is_planned_anew(spark):
    """Copies that one task counts are sent by whatever tasks of the second pass meet them, in any order."""
    text = " ".join(f"w{i}" for i in range(60))
    dealt = lambda ids, tasks: spark.createDataFrame(spark.sparkContext.parallelize([(i, text) for i in ids], tasks), "doc_id long, text string")
    twice, hot = (spark.sparkContext.broadcast(b) for b in sd.sketch(dealt((5, 10, 20), 1), sd.BLOCK, 50))
    for second in (dealt((5, 10), 2), dealt((10, 5), 1)):
        found = sd.repeated_windows(second, sd.BLOCK, 50, twice, hot).collect()
        assert sorted((r.doc_id, r.place) for r in found) == [(d, k) for d in (5, 10) for k in range(11)]
