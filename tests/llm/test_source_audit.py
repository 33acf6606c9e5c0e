import random
import re
from collections import Counter, defaultdict

from leadloom.llm import source_audit as sa

UNIT = 1_000_000_000


def brute(rows, min_docs=3, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df = Counter(t for lg, _, ws in found if lg == lang for t in set(ws))
        kept = {t for t, n in df.items() if n >= min_docs}
        per = defaultdict(Counter)
        for lg, source, ws in found:
            if lg == lang:
                per[source].update(w for w in ws if w in kept)
        whole = sum(per.values(), Counter())
        p = {s: {t: 1 + UNIT * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in per.items()}
        q = {t: 1 + UNIT * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in per:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in per if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if per[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:most])]
    return sorted(out)


def corpus(seed, n=150):
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Ab", "é", "zz", "日本", "q") for b in ("x", "Y", "ö", "", "kk")]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = []
    for _ in range(n):
        words = rnd.choices(vocabulary, weights, k=rnd.randint(0, 30))
        rows.append((rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s3", "s10", None, "É"]), rnd.choice([" ", "-", "1", "\n"]).join(words)))
    return rows + [("fr", "alone", "Wort wort wort"), ("xx", "a", "one"), ("xx", "b", ""), ("xx", None, None), ("en", "none", "@@ 12"), ("en", "long", "Ab zz " * 50_000)]


def made(spark, rows, **more):
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as count", "2 as items", "3 as p", "'x' as term").repartition(6)
    return sorted(tuple(r) for r in sa.audit(df, **more).collect())


def test_matches_brute_force(spark):
    rows = corpus(1)
    assert made(spark, rows + rows[:20]) == brute(rows + rows[:20])


def test_list_length_and_ties(spark):
    rows = [("en", s, t) for s in ("a", "b") for t in ("u v w", "u v w", "u")] + [("en", "c", "k l m k l m")] * 3
    assert made(spark, rows, top=2) == brute(rows, top=2)


def test_sent_in_pieces(spark, monkeypatch):
    """A task that sends its counts often, and trees that are settled often, give the same sums."""
    rows = corpus(2, 60)
    monkeypatch.setattr(sa, "HELD", 3)
    assert made(spark, rows) == brute(rows)


def test_tree_holds_each_pair_once():
    tree = sa.PatternTree()
    a, b, c = ("a", 2, 40, 10), ("b", 1, 30, 20), ("c", 5, 90, 10)
    for items, times in (([a, b], 3), ([a, b, c], 2), ([b, c], 1)):
        tree.insert(items, times)
    tree.close()
    assert sorted((n[0], n[1], n[-1]) for n in tree.nodes) == [("a", "b", 5), ("a", "c", 2), ("b", "c", 1), ("b", "c", 2)]


def test_empty_table(spark):
    assert sa.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
