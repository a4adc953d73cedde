"""The corpus pipeline on planted cases."""

import numpy as np

import corpus_pipeline
from roadloom.llm import mixing, token_files


def test_stages_on_planted_documents(spark, tmp_path):
    rng = np.random.default_rng(7)
    vocab = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu") for b in ("ran", "tel", "sor", "vik", "dup", "fem")]
    clean = [" ".join(rng.choice(vocab, 60)) for _ in range(60)]
    leak = " ".join(rng.choice(vocab, 30))
    poor, rude = [[f"{a} {a} {b} " + " ".join(rng.choice(vocab, 30)) for _ in range(12)] for a, b in (("buy", "click"), ("zut", "grr"))]
    texts = clean + [clean[0], clean[0], "see " + leak + " end", None, "", "123 456", *poor, *rude]
    rows = [(i, t, "en" if i % 3 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i < 60), int(i >= 78)) for i in [*range(60), *range(66, 90)]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"s{k}")
        res = stage(spark, now, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert res.columns == docs.columns, name
        res.write.parquet(out)
        now = spark.read.parquet(out)
        ids.append(sorted(r.doc_id for r in now.select("doc_id").collect()))
    more = list(range(66, 90))
    assert ids[0] == [*range(63), *more]
    assert ids[1] == [*range(60), 62, *more]
    assert ids[2] == [*range(60), *more]
    assert ids[4] == ids[3]
    # what is mixed are the documents before: their rates meet the targets, and good ones all stay
    before = spark.read.parquet(str(tmp_path / "s2"))
    mixed = mixing.mix(before, spark.read.parquet(str(tmp_path / "labels.parquet"))).toPandas()
    total = np.array([(mixed.rate * mixed.n_tokens * mixed[f"p_{d}"]).sum() for d in mixing.DOMAINS])
    assert np.allclose(total / total.sum(), [mixing.TARGETS[d] for d in mixing.DOMAINS], rtol=1e-3)
    assert ids[3] == sorted(i for i, n in zip(mixed.doc_id, mixed.copies, strict=True) for _ in range(n)) and set(range(60)) <= set(ids[3])
    last = now.orderBy("start").collect()
    assert last[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(last, last[1:], strict=False))
    assert token_files.END_ID == 0
