import hashlib
import math
import random

from pyspark.sql import functions as F

from leadloom.llm import multiset_hash as mh


def vectors(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    made = mh.summed(df.select("i", F.explode_outer(mh.paragraphs(F.col("text"))).alias("part")), ["i"])
    return {r.i: r.vector for r in made.collect()}


def test_order_insertion_and_deletion(spark):
    v = vectors(spark, ["one.\ntwo.\nthree.", "three.\none.\ntwo.", "one.\ntwo.", "three.", "one.\none.\ntwo.", "", "  \n\n ", "a. b! c?", "c?\nb!\na."])
    assert v[0] == v[1] != v[2] and v[4] != v[2] and v[5] == v[6] == [0] * (mh.LANES + 1) and v[7] == v[8]
    df = spark.createDataFrame([(v[2], v[3], v[0])], "a array<bigint>, b array<bigint>, c array<bigint>")
    r = df.select(mh.combined(F.col("a"), F.col("b")).alias("added"), mh.combined(F.col("c"), F.col("b"), -1).alias("left")).first()
    assert r.added == v[0] and r.left == v[2]


def expected(rows):
    """Rows in order of id (null last, ties by text) with the edited text."""
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    firsts = [t for i, t in ordered if i is not None]
    out = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[k + 1][1] if k + 1 < len(ordered) else (firsts[0] if firsts else "")
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, after))
    return out


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(mh, "RANGE_ROWS", 7)
    rnd = random.Random(1)
    sentence = lambda: " ".join("".join(rnd.choice("abcdeé🙂") for _ in range(5)) for _ in range(6)) + rnd.choice([".", "!", "?\n"])
    rows = [(rnd.randrange(10**12) if i % 2 else i, " ".join(sentence() for _ in range(rnd.randint(0, 20)))) for i in range(150)]
    rows += [(rows[3][0], rows[3][1]), (10**13, rows[4][1]), (5_000_001, None), (5_000_002, ""), (None, rows[6][1]), (7_000_000, sentence() * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as range", "2 as lent", "3 as vector").repartition(6)
    got = mh.compared(df).collect()
    want = expected(rows)
    key = lambda r: (repr(r[0]), r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted((w[:3] for w in want), key=key)
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    by_text = {}
    for w in want:
        by_text.setdefault(w[3], set()).update(prints[w[0], w[1]])
    assert all(len(p) == 1 for p in by_text.values())
    assert len({next(iter(p)) for p in by_text.values()}) == len(by_text)
    many = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited for r in many) / len(many) > 0.35
    assert sum(r.near_next for r in many) / len(many) < 0.15
    assert all(math.isclose(r.near_edited, 1.0) for r in got if r.fingerprint == r.edited_fingerprint)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert mh.compared(none).collect() == []
    one = mh.compared(spark.createDataFrame([(5, "ab. cd.")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in one] == [(5, 7, hashlib.sha256(b"ab. ab.").hexdigest(), 1.0)]
    alone = mh.compared(spark.createDataFrame([(None, "abcd")], "doc_id long, text string")).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"ab").hexdigest()


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    plan = mh.compared(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
