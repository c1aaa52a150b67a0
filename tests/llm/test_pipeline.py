"""The pipeline over a small folder of tables with planted documents."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
LETTERS = "abcdefghijklmnoprstuvw"


def fresh(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randrange(4, 9))) for _ in range(n))


def test_planted_documents(spark, tmp_path):
    rng = random.Random(11)
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    item = next(r["text"] for r in tables["benchmark"].orderBy("item_id").collect() if len(r["text"].split()) >= 20)
    clean = {900_000 + i: "\n".join(fresh(rng, 14) for _ in range(6)) for i in range(5)}
    near = clean[900_001].split()
    near[40] = "changed"
    passage = fresh(rng, 70)
    planted = {**clean,
               910_000: clean[900_000],  # an exact copy
               910_001: " ".join(near),  # a near copy with other lines
               910_002: fresh(rng, 30) + " " + item + " " + fresh(rng, 30),  # a leak
               910_003: fresh(rng, 40) + " " + passage + " " + fresh(rng, 40), 910_004: fresh(rng, 50) + " " + passage + " " + fresh(rng, 50),
               910_005: None, 910_006: ""}
    columns = tables["documents"].columns
    rows = spark.createDataFrame([(i, t, "en", "planted", len(t) if t is not None else None) for i, t in planted.items()],
                                 "doc_id long, text string, lang string, source string, n_chars long").select(columns)
    documents = tables["documents"].withColumn("n_chars", F.col("n_chars").cast("long")).unionByName(rows)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        tables[t].write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    texts = {r["doc_id"]: r["text"] for r in docs.where("source = 'planted'").collect()}
    assert all(texts.get(i) == t for i, t in clean.items())
    assert not {910_000, 910_002} & set(texts) and passage in texts[910_003] and passage not in texts[910_004]
    assert len(texts[910_004].split()) >= 99 and {910_005, 910_006} & set(texts)
    toxic = {r["doc_id"] for r in tables["labels"].where("toxic = 1").collect()}
    left = {r["doc_id"] for r in docs.collect()}
    assert len(toxic & left) <= 0.2 * len(toxic)

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == left
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
