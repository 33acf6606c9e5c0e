import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from leadloom.llm import ngram_join, quality_crf
from .test_exact_and_mix import targets
from .test_models import labelled
from .test_ngram_join import brute


def test_stages(spark, tmp_path):
    rows, labels = labelled(8, 400)
    docs = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows]
    docs += [(1000 + k, docs[k][1], "en", "src1", 5) for k in range(20)] + [(2000 + k, docs[k][1] + " end", "en", None, 5) for k in range(20)]
    docs += [(3000, None, None, None, None), (3001, "", "en", "src0", 0), (None, "A line of words without an id stays here.", "en", "src0", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "source mix", "BPE encoding and decoding"]
    table, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, table, str(tmp_path))
        if k < 4:
            assert made.columns == table.columns
        made.write.parquet(f"{tmp_path}/stage{k}")
        after = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/stage{k}").collect()]
        if k == 0:
            good = {r.doc_id for r in quality_crf.quality(table, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r.predicted}
            assert sorted(after, key=repr) == sorted((d for d in before if d[0] in good), key=repr) and len(after) < len(before)
        elif k == 1:
            least = {}
            for d in sorted(before, key=lambda d: (d[0] is None, d[0] or 0)):
                least.setdefault(d[1] or "", d)
            assert sorted(after, key=repr) == sorted(least.values(), key=repr) and len(after) < len(before)
        elif k == 2:
            stays = {i for i, _, c in brute([d[:2] for d in before]) if i == c}
            assert sorted(after, key=repr) == sorted((d for d in before if d[0] in stays), key=repr) and len(after) < len(before)
        elif k == 3:
            size = lambda d: len((d[1] or "").split())
            own, taken = {}, {}
            for d in before:
                own[d[3]] = own.get(d[3], 0) + size(d)
            for d in after:
                assert d in before and after.count(d) <= 3
                taken[d[3]] = taken.get(d[3], 0) + size(d)
            for s, t in targets(own).items():
                assert abs(t - taken.get(s, 0)) <= max(60, 0.05 * t)
        else:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            text = {d[0]: d[1] or "" for d in before}
            assert len(after) == len(before)
            for i, n, ids, decoded in after:
                want = library.encode(text[i], add_special_tokens=False).ids
                assert ids == want and n == len(want) and decoded == library.decode(want, skip_special_tokens=False)
        table, before = spark.read.parquet(f"{tmp_path}/stage{k}"), after
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr) == sorted(after, key=repr)


def test_representatives_keep_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "i"), (2, "a b c d e f", "j"), (None, "a b c d e f", "k")], "doc_id long, text string, i string")
    assert {(r.doc_id, r.i) for r in ngram_join.representatives(df).collect()} == {(1, "i"), (None, "k")}
    assert np.all([len(s) == 1 for s in ngram_join.shingle_sets([b"x", b"x y", b"a b c d e"])])
