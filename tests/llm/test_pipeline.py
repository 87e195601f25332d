from collections import defaultdict

import corpus_pipeline
from tests.llm import docs
from tests.llm.test_models import corpus


def test_stages(spark, tmp_path):
    """Every stage works on what the one before kept, and its decisions take effect."""
    rows, labels = corpus()
    rows += [(1000 + k, rows[2][1], "t") for k in range(5)] + [(2000, rows[3][1] + "\n", "t"), (3000, rows[4][1] + " extra", None), (4000, None, "t")]
    table = docs.table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        at = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = at.collect()
        if k < 4:
            assert at.columns == table.columns
    quality = {k: q for k, q, _ in labels}
    good = {r.doc_id for r in seen["quality"]}
    assert good & set(quality) == {k for k, q in quality.items() if q}
    exact = {r.doc_id for r in seen["exact dedup"]}
    assert exact == {r for r in good if not 1000 <= r < 2000 and r != 3}  # 2000 is longer than 3
    near = {r.doc_id for r in seen["near dedup"]}
    assert 3000 not in near and near <= exact and len(near) >= len(exact) - 2
    taken = defaultdict(int)
    for r in seen["mixing"]:
        taken[r.doc_id] += len((r.text or "").split())
    assert set(taken) <= near and all(n <= 2 * len(r.text.split()) for r in seen["near dedup"] for n in [taken[r.doc_id]])
    assert {r.doc_id for r in seen["packing"]} == set(taken)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])
