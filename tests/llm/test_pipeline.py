"""The pipeline's stages on planted documents."""

import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_catch_what_is_planted(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(900)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    clean = [(k, text(150)) for k in range(160)]
    insults = ["vilk", "drogue", "snarf"]
    toxic = [(1000 + k, " ".join(w if rng.random() > 0.1 else rng.choice(insults) for w in text(80).split())) for k in range(40)]
    item = text(30)
    leaks = [(200, text(50) + " " + item + " " + text(40))]
    copies = [(300, clean[0][1]), (301, clean[1][1])]
    swapped = clean[2][1].split()
    swapped[70] = "changed"
    near = [(400, " ".join(swapped))]
    docs = spark.createDataFrame([(d, t, "en", "src", len(t or "")) for d, t in clean + toxic + leaks + copies + near + [(500, None)]], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path / "sf")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(d, 0) for d, _ in clean] + [(d, 1) for d, _ in toxic], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    cur, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, cur, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        cur = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in cur.select("doc_id").collect()}
    assert not seen["toxicity"] & {d for d, _ in toxic} and {d for d, _ in clean} <= seen["toxicity"]
    assert len(seen["exact_dedup"] & {0, 300}) == 1 and len(seen["exact_dedup"] & {1, 301}) == 1
    assert len(seen["near_dedup"] & {2, 400}) == 1 and {d for d, _ in clean[3:]} <= seen["near_dedup"]
    assert 200 not in seen["decontamination"] and seen["near_dedup"] - seen["decontamination"] == {200}
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == seen["decontamination"]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
