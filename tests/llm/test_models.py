import random
import zlib

import numpy as np
import pytest

from leadloom.llm import language_id, quality_crf


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def good_line(rnd):
    return " ".join("".join(rnd.choice("aeioustrln") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(5, 15))).capitalize() + "."


def bad_line(rnd):
    return rnd.choice([lambda: "BUY!! NOW!! " * 6, lambda: " | ".join(["home", "about", "login", "menu"] * 3), lambda: "$$$ ### %%% " * 5])()


def labelled(seed, n=600):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rnd.random() < 0.3
        lines = [bad_line(rnd) if bad and rnd.random() < 0.7 else good_line(rnd) for _ in range(rnd.randint(2, 9))]
        if bad and not any("!!" in x or "|" in x or "$" in x for x in lines):
            lines.append(bad_line(rnd))
        rows.append((i, "\n".join(lines)))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_quality_on_held_out_documents(spark):
    rows, labels = labelled(5)
    extra = [(9001, ""), (9002, None), (None, rows[0][1]), (3, rows[3][1]), (9003, "Good words here and there.\n" * 20_000)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as row").repartition(4)
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int").selectExpr("*", "1 as text")
    got = quality_crf.quality(docs, marks).collect()
    assert len(got) == len(rows) + len(extra)
    want = dict(labels)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    tested = [(r.score, want[r.doc_id]) for r in got if r.held_out and r.doc_id in want]
    ones, zeros = [s for s, y in tested if y], [s for s, y in tested if not y]
    assert np.mean([a > b for a in ones for b in zeros]) > 0.97
    assert np.mean([s >= 0.3 for s in ones]) > 0.97
    empties = {r.score for r in got if r.doc_id in (9001, 9002)}
    assert len(empties) == 1
    kept = quality_crf.accepted(docs, marks)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in got if r.predicted), key=repr)
    assert sorted((r.doc_id, r.score) for r in quality_crf.quality(docs.repartition(7), marks).filter("doc_id < 100").collect()) == sorted((r.doc_id, r.score) for r in got if (r.doc_id or 999) < 100 or r.doc_id == 0)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality_crf.quality(docs, none).collect()} == {(0.5, 1)}
    assert quality_crf.quality(docs.limit(0), none).collect() == quality_crf.accepted(docs.limit(0), none).collect() == []
    only = spark.createDataFrame([(i, 0) for i in range(1, 30)], "doc_id long, quality int")
    assert {r.score for r in quality_crf.quality(docs, only).collect() if r.doc_id} == {0.0}


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    first = np.array([0, 1, 4, 9])
    unary, pair = rng.normal(size=(12, 2)), rng.normal(size=(2, 2))
    good, expected, total = quality_crf.Chains(first, 12).marginals(unary, pair)
    ends, log_z, want, moves = [1, 4, 9, 12], 0.0, np.zeros(12), np.zeros((2, 2))
    for a, b in zip(first, ends):
        weights = {}
        for code in range(2 ** (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            weights[tuple(y)] = np.exp(sum(unary[a + k, v] for k, v in enumerate(y)) + sum(pair[u, v] for u, v in zip(y, y[1:])))
        z = sum(weights.values())
        log_z += np.log(z)
        for y, w in weights.items():
            for k, v in enumerate(y):
                want[a + k] += v * w / z
            for u, v in zip(y, y[1:]):
                moves[u, v] += w / z
    assert np.allclose(good, want) and np.allclose(expected, moves) and np.isclose(total, log_z)


def test_line_labels():
    rows, labels = labelled(6, 300)
    model = quality_crf.fit(quality_crf.lines_of([t.encode() for _, t in rows]), np.array([y for _, y in labels]))
    told = quality_crf.line_labels(model, "A plain line of many quiet words here.\nBUY!! NOW!! BUY!! NOW!!\nAnother plain line with words in it.")
    assert told[1][1] < 0.5 < min(told[0][1], told[2][1])
    scores = model.scores(quality_crf.lines_of([b"", b"\n\n", "é\n".encode() * 3]))
    assert scores.shape == (3,)


LANGS = {"en": ["the", "and", "this", "with", "word", "house"], "de": ["und", "nicht", "straße", "für", "ich", "haus"], "el": ["και", "το", "είναι", "με", "από", "σπίτι"]}


def spoken(lang, rnd, n):
    return " ".join(rnd.choice(LANGS[lang]) for _ in range(n))


def test_languages(spark):
    rnd = random.Random(2)
    rows = [(i, spoken(lang := rnd.choice(list(LANGS)), rnd, rnd.randint(4, 60)), lang) for i in range(500)]
    truth = {i: lang for i, _, lang in rows}
    given = [(i, t, None if i % 50 == 0 else lang) for i, t, lang in rows]
    extra = [(9001, None, "en"), (9002, "", "en"), (9003, "123 --- !!", "de"), (None, spoken("de", rnd, 9), "en"), (7, rows[7][1], rows[7][2]), (9004, spoken("el", rnd, 60_000), None)]
    docs = spark.createDataFrame(given + extra, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'q' as source").repartition(4)
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows) + len(extra)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (9001, 9002, 9003, 9004)] == ["und", "und", "und", "el"]
    assert by_id[None].lang_pred == "de"
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs.repartition(7)).filter("doc_id < 50").collect()) == sorted((r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id is not None and r.doc_id < 50)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs).collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 4, 9, 40])
def test_codewords_are_apart(n):
    code = language_id.codewords(n)
    assert code.shape[0] == n and (n == 1 or min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 3)


def test_an_even_mixture_is_ambiguous():
    rnd = random.Random(4)
    texts = [(spoken(lang, rnd, 30), lang) for lang in LANGS for _ in range(60)]
    model = language_id.fit(language_id.features([t.encode() for t, _ in texts]), [x for _, x in texts])
    clear = [spoken(lang, rnd, 30) for lang in LANGS]
    mixed = [" ".join(sum(([rnd.choice(LANGS["en"]), rnd.choice(LANGS["de"])] for _ in range(30)), []))]
    margins = [np.diff(np.sort(model.losses(language_id.features([t.encode()]))[0])[:2])[0] for t in clear + mixed]
    assert margins[-1] < min(margins[:-1])


def test_decoding_by_a_loop_over_all_codewords():
    """The nearest codeword, its share and the flag, computed word by word and bit by bit."""
    rng = np.random.default_rng(5)
    names = [f"l{k}" for k in range(9)]
    x = rng.normal(size=(60, language_id.PAIRS + language_id.TRIPLES)).astype(np.float32) / 60
    langs = [names[i % 9] for i in range(60)]
    for i, v in enumerate(langs):
        x[i, names.index(v) * 7: names.index(v) * 7 + 5] += 0.2
    model = language_id.fit(x, langs)
    best, share, unclear = model.decode(x)
    for i in range(60):
        losses = []
        for word in model.code:
            total = 0.0
            for b, bit in enumerate(word):
                margin = 3.0 * (float(x[i].astype(np.float64) @ model.weights[:, b]) + model.bias[b])
                total += model.trust[b] * np.log1p(np.exp(-margin * bit))
            losses.append(total / model.trust.sum())
        order = np.argsort(losses)
        assert best[i] == order[0] and unclear[i] == (losses[order[1]] - losses[order[0]] < language_id.AMBIGUOUS)
        assert abs(share[i] - 1 / sum(np.exp(-8 * (v - losses[order[0]])) for v in losses)) < 1e-3


def test_every_language_is_learned(spark):
    """More languages than the sample has places: a rare one is learned too."""
    rows = [(i, f"word{i % 40} text of language {i % 40} " * 5, f"l{i % 40:02d}") for i in range(2000)] + [(5001, "zzz xyxy qqq " * 9, "rare"), (5002, "zzz xyxy qqq " * 9, "rare"), (5003, "zzz xyxy qqq " * 9, "rare")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=20).filter("doc_id > 5000").collect()
    assert {r.lang_pred for r in got} == {"rare"}
