from collections import Counter

import corpus_pipeline


def test_stages_filter_and_keep_columns(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    frames = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], str(tmp_path)).write.parquet(str(tmp_path / f"{i}"))
        frames.append(spark.read.parquet(str(tmp_path / f"{i}")))
    assert all(f.columns == docs.columns for f in frames[:-1])
    ids = [Counter(x["doc_id"] for x in f.select("doc_id").collect()) for f in frames]
    dropped = set(ids[0]) - set(ids[1])
    assert dropped >= {500, 501, 502, 505} and dropped <= {*range(500, 510), None}
    assert not any(400 <= d < 500 for d in ids[2] if d is not None) and {*range(120), *range(200, 220), *range(320, 340)} <= set(ids[2])
    assert set(range(120)) <= set(ids[3]) and not any(200 <= d < 400 for d in ids[3] if d is not None) and max(ids[3].values()) == 1
    assert max(ids[4].values()) == 2
    assert {x["doc_id"] for x in frames[5].select("doc_id").collect()} == set(ids[4])
