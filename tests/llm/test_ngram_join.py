import random
from itertools import combinations

import numpy as np
import pytest

from leadloom.llm import ngram_join as nj


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i)) for i, s in sets), key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdEé") for _ in range(rnd.randint(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    shared = text(30)
    rows, i = [], 0
    for _ in range(12):
        base = text(rnd.randint(3, 150))
        for _ in range(rnd.randint(1, 9)):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = word()
            if rnd.random() < 0.3:
                own += shared
            if rnd.random() < 0.3:
                own = own[: rnd.randint(1, len(own))]
            rows.append((i, " ".join(own) if rnd.random() < 0.7 else "\n".join(own).upper()))
            i += rnd.randint(1, 4)
    rows += [(5000, ""), (5001, None), (5002, " \t"), (5003, "one two"), (5004, "ONE two"), (5005, "one two x"), (None, rows[3][1])]
    rows += [rows[5], (6000, rows[5][1]), (-3, rows[8][1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed, monkeypatch):
    if seed > 1:  # trees of several levels
        monkeypatch.setattr(nj, "FAN", 2)
    if seed == 3:  # every bucket is cut into parts
        monkeypatch.setattr(nj, "BLOCK", 3)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as node", "1 as n").repartition(4)
    assert sorted((tuple(r) for r in nj.similar(df).collect()), key=repr) == brute(rows)


def test_chains_and_a_hub_that_links_to_nobody(spark):
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(12):  # each links to the next only
        own = list(base)
        own[: 3 * k] = [f"v{j}" for j in range(3 * k)]
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in nj.similar(df).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("seed", [0, 1])
def test_an_id_of_several_texts_links_by_each(spark, seed):
    rnd = random.Random(seed)
    say = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    rows, stories = [], [say() for _ in range(12)]
    for k, own in enumerate(stories):  # ids 100, 101, ... have two texts each; others are near one of them
        rows += [(100 + k // 2, " ".join(own)), (k, " ".join([*own[1:], "end"])), (50 + k, " ".join([*own[:-1], "start"]))]
    for own, other in ((say(), 201), (say(), 202)):  # the buckets of id 200 with 201 and with 202 hold these twice
        rows += [(200, " ".join(own)), (other, " ".join([*own, "more"])), (other, " ".join([*own, "less"]))]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in nj.similar(df).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert nj.similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tree_rules_out_no_link():
    rnd = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = rnd.integers(0, 1 << 62, rnd.integers(1, 300)).astype(np.uint64)
        for _ in range(5):
            sets.append(np.unique(np.concatenate([base[rnd.random(len(base)) < 0.95], rnd.integers(0, 1 << 62, len(base) // 20).astype(np.uint64)])))
    counts, sizes = [nj.points(s) for s in sets], np.array([len(s) for s in sets])
    all_, kinds = np.ones(len(sets), bool), np.arange(len(sets))
    pair = lambda ps: {(min(p), max(p)) for p in ps}
    near = pair(nj.other_pairs(counts, sizes, all_, all_, kinds))
    for i, j in combinations(range(len(sets)), 2):
        shared = len(np.intersect1d(sets[i], sets[j]))
        bound = nj.shared_at_most(counts[i], counts[j])
        assert shared <= bound
        assert ((i, j) in near) == (9 * bound >= 4 * (sizes[i] + sizes[j]))
        if 9 * shared >= 4 * (sizes[i] + sizes[j]):
            assert (i, j) in near
    assert len(near) < 700
    # The first round names every row that is near another.
    first = pair(nj.first_pairs(counts, sizes, all_, all_))
    assert {x for p in first for x in p} == {x for p in near for x in p} and first <= near
    halves = np.arange(len(sets)) % 2 == 0
    crossed = {p for p in near if halves[p[0]] != halves[p[1]]}
    assert pair(nj.other_pairs(counts, sizes, halves, ~halves, kinds)) == crossed
    # Two parts and what is across them name the same rows.
    across = pair(nj.first_pairs(counts, sizes, halves, ~halves))
    parts = across | pair(nj.first_pairs(counts, sizes, halves, halves)) | pair(nj.first_pairs(counts, sizes, ~halves, ~halves))
    assert across <= crossed and {x for p in parts for x in p} == {x for p in near for x in p}
    some = kinds // 5 % 3
    assert pair(nj.other_pairs(counts, sizes, all_, all_, some)) == {p for p in near if some[p[0]] != some[p[1]]}


@pytest.mark.parametrize("n", [100, 400, 1600])
def test_copies_in_two_parts_give_pairs_in_proportion(n):
    rnd = np.random.default_rng(n)
    base = rnd.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.where(rnd.random(200) < 0.01, rnd.integers(0, 1 << 62, 200).astype(np.uint64), base)) for _ in range(n)]
    counts, sizes, halves = [nj.points(s) for s in sets], np.array([len(s) for s in sets]), np.arange(n) % 2 == 0
    cells = [(halves, halves), (halves, ~halves), (~halves, ~halves)]
    assert sum(len(nj.first_pairs(counts, sizes, *cell)) for cell in cells) <= 2 * n
