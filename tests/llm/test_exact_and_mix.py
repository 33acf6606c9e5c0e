import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leadloom.llm import exact_dedup, mixing

ROWS = [(3, "a"), (1, "a"), (2, "b"), (7, ""), (8, None), (None, "a"), (None, "c"), (None, "c"), (2, "b"), (9, "b "), (4, "x" * 200_000), (5, "x" * 200_000)]


def expected(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        chosen = (min if keep == "smallest" else max)(known) if known else None
        used = False
        for i in ids:
            kept = i == chosen and not used
            used |= kept
            out.append((i, chosen, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("digest", [exact_dedup.content_hash, lambda c: F.substring(F.unhex(F.md5(c)), 1, 0), lambda c: F.lit("same")])
def test_exact(spark, keep, digest):
    """Also with digests that collide for all texts: bytes decide."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as keep_id").repartition(4)
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(df, keep=keep, digest=digest).collect()), key=repr)
    assert got == expected(ROWS, keep)


def test_documents_kept_as_they_are(spark):
    df = spark.createDataFrame([(*r, "s", k) for k, r in enumerate(ROWS)], "doc_id long, text string, sha string, row int")
    got = exact_dedup.distinct_documents(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, "a"), (2, "b"), (7, ""), (None, "c"), (9, "b "), (4, "x" * 200_000)])
    assert exact_dedup.exact_dedup(df.limit(0)).collect() == exact_dedup.distinct_documents(df.limit(0)).collect() == []


def targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / (sum(weight[s] for s in free) or 1)
        over = [s for s in free if weight[s] * share > limit * sizes[s]]
        if not over:
            return {**fixed, **{s: weight[s] * share for s in free}}
        fixed |= {s: limit * sizes[s] for s in over}


def mixture(seed):
    rnd = random.Random(seed)
    share = {"src0": 0.4, "src1": 0.02, "Ä": 0.2, "z": 0.1, "\U0001F600": 0.1, "￮": 0.1, None: 0.05, "tiny": 0.03}
    rows = []
    for i in range(3000):
        source = rnd.choices(list(share), share.values())[0]
        n = int(rnd.lognormvariate(3, 1.3))
        rows.append((i, " ".join(["w"] * n) if n else rnd.choice(["", None, " \t"]), source))
    return rows


def test_mix(spark):
    rows = mixture(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as hash", "2 as size").repartition(3)
    got = mixing.mix(df).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    assert {r.doc_id: r.size for r in got} == size and len(got) == len(rows)
    own = Counter()
    for i, _, s in rows:
        own[s] += size[i]
    want, taken = targets(own), Counter()
    for r in got:
        assert r.source_size == own[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.copies <= 3 * r.size
        taken[r.source] += r.taken
    for s in own:
        assert 0 <= want[s] - taken[s] <= max(5, 0.002 * want[s])
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    repeats = Counter(r.doc_id for r in mixing.mixed(df).collect())
    assert repeats == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.mixed(df).columns == df.columns


def test_mix_small_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).collect() == mixing.mixed(none).collect() == []
    blank = spark.createDataFrame([(1, None, None), (1, None, None), (2, "", "a"), (None, " ", "a")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.taken, r.target) for r in mixing.mix(blank).collect()} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0), (None, 0, 0, 0.0)}
