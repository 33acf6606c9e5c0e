import hashlib
import random
from collections import defaultdict

import pytest

from leadloom.llm import suffix_repeats as sr


def brute(rows, length):
    places = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        for k in range(len(t) - length + 1):
            places[t[k: k + length]] += 1
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if places[t[k: k + length]] > 1:
                gone[k: k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=60, longest=300):
    rnd = random.Random(seed)
    letters = lambda k: "".join(rnd.choice("abcdeé \n") for _ in range(k))
    passages = [letters(rnd.randint(20, longest)) for _ in range(8)]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(passages) if rnd.random() < 0.5 else letters(rnd.randint(0, 120)) for _ in range(rnd.randint(0, 4)))
        if text and rnd.random() < 0.3:
            at = rnd.randrange(len(text))
            text = text[:at] + rnd.choice(["", "x", "yy"]) + text[at + 1:]
        rows.append((i, text))
    rows += [(900, None), (901, ""), (902, rows[3][1]), (902, rows[3][1]), (None, rows[5][1]), (903, "z" * 700), (904, "ab" * 300), (905, "b" + "ab" * 200)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("length", "anchor", "together", "piece"), [(40, 10, 2048, 1 << 20), (40, 10, 3, 150), (90, 25, 2, 1 << 20), (12, 12, 5, 64)])
def test_matches_brute_force(spark, monkeypatch, length, anchor, together, piece):
    for name, x in (("ANCHOR", anchor), ("TOGETHER", together), ("PIECE", piece), ("GATHERED", 4000)):
        monkeypatch.setattr(sr, name, x)
    rows = corpus(length + together)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as text_id", "'x' as copies").repartition(5)
    assert sorted((tuple(r) for r in sr.remove_repeats(df, length=length, digests=True).collect()), key=repr) == brute(rows, length)


def test_repeats_have_all_their_occurrences(spark, monkeypatch):
    """Every repeat spells one string, is maximal where its anchor does not cut it, and no place of it is missing."""
    monkeypatch.setattr(sr, "ANCHOR", 10)
    rows = [(i, t) for i, t in corpus(5, 40, 80) if i is not None and i != 902]
    length = 30
    found = sr.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()
    texts = {i: (t or "").encode() for i, t in rows}
    own, parents, strings = defaultdict(set), {}, {}
    for r in found:
        own[bytes(r["repeat"])].add((r.doc_id, r.start))
        string = texts[r.doc_id][r.start: r.start + r.length]
        assert len(string) == r.length >= length
        assert strings.setdefault(bytes(r["repeat"]), string) == string
        if r.parent is not None:
            parents[bytes(r["repeat"])] = bytes(r.parent)
    below = defaultdict(set)
    for name, places in own.items():
        while name is not None:
            below[name] |= places
            name = parents.get(name)
    assert len(own) > 10
    for name, string in strings.items():
        every = {(i, k) for i, t in texts.items() for k in range(len(t)) if t.startswith(string, k)}
        assert below[name] == every and len(every) > 1


def test_intervals_by_enumeration():
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choice("ab") for _ in range(rnd.randint(2, 25))).encode()
        order = sorted(range(len(text)), key=lambda k: text[k:])
        lcp = [0, *(sr.common_prefix(text[a:], text[b:]) for a, b in zip(order, order[1:]))]
        nodes = sr.prefix_intervals(lcp, [text[k - 1] if k else -1 for k in order], 1)
        got = {text[order[a]: order[a] + n]: {order[k] for k in range(a, b + 1)} for n, a, b, _ in nodes}
        want = {}
        for k in range(len(text)):
            for n in range(1, len(text) - k + 1):
                s = text[k: k + n]
                at = {j for j in range(len(text)) if text.startswith(s, j)}
                left = {text[j - 1] if j else ("start",) for j in at}
                right = {text[j + n] if j + n < len(text) else ("end",) for j in at}
                if len(at) > 1 and len(left) > 1 and len(right) > 1:
                    want[s] = at
        assert got == want
        for i, (n, a, b, parent) in enumerate(nodes):
            assert parent < i
            if parent >= 0:
                assert nodes[parent][0] < n and nodes[parent][1] <= a and b <= nodes[parent][2]


def test_empty_table_and_kept_bytes(spark):
    assert sr.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(450))
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in sr.remove_repeats(spark.createDataFrame([(1, "é" + one), (2, one + "!"), (3, one[:399])], "doc_id long, text string")).collect()}
    assert got == {1: (450, 1, "é"), 2: (450, 1, "!"), 3: (0, 0, one[:399])}
