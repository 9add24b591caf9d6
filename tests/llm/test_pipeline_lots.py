"""The pipeline's toxicity stage with models of more expressions than are held at a time."""

import numpy as np
from test_toxicity import SCHEMA, corpus

import corpus_pipeline
from weftline.llm import toxicity


def test_the_stage_leaves_no_expression_out(spark, tmp_path, monkeypatch):
    rows, labels = corpus(240, np.random.default_rng(12), every=2)
    rows += [(900, None, None, None), (None, "vile vile vile", None, None), (7, rows[7][1], "en", "s")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, used, score = spark.createDataFrame(rows, SCHEMA), [], toxicity.score_texts
    monkeypatch.setattr(toxicity, "score_texts", lambda d, m, **k: used.append(m) or score(d, m, **k))
    kept = []
    for most in (toxicity.MOST_EXPRESSIONS, 40):
        monkeypatch.setattr(toxicity, "MOST_EXPRESSIONS", most)
        left = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
        assert left.columns == docs.columns
        kept.append(sorted(tuple(map(str, r)) for r in left.collect()))
    assert kept[0] == kept[1] and 0 < len(kept[0]) < len(rows) - 50
    whole, lots = used
    assert len(whole.words) + len(whole.stems) + sum(map(len, whole.after.values())) == lots.parts.count() > 40
