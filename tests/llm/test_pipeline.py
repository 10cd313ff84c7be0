"""The pipeline's stages against plain versions, on planted documents."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_models import brute_components, sentence


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    at = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for k in range(500):
        words = sentence(rng, 70).split()
        if k % 5 == 0:
            words[rng.randrange(70)] = rng.choice(["dreadfool", "nastyword"])
        if k % 7 == 0:
            words = [w + rng.choice("$%#*") * 3 for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 7 != 0), int(k % 5 == 0)))
    base = [t for k, t in rows if k % 5 and k % 7][:5]
    rows += [(1000 + k, t if k % 2 else t + " tail") for k, t in enumerate(base)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    read = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before = read(docs)

    clean = pipeline.toxicity_stage(spark, docs, folder)
    assert clean.columns == docs.columns
    mild = read(clean)
    want = {i for i in before if i >= 1000 or i % 5}
    assert len(set(mild) ^ want) <= 3

    good = pipeline.quality_stage(spark, clean, folder)
    assert good.columns == docs.columns
    kept = read(good)
    assert len({i for i in kept if i < 1000} ^ {i for i in mild if i < 1000 and i % 7}) <= 3

    single = pipeline.near_duplicate_stage(spark, good, folder)
    assert single.columns == docs.columns
    parts = brute_components(list(kept.items()), 5, 80)
    assert set(read(single)) == {i for i, (_, top) in parts.items() if i == top}
    assert not {1000, 1001, 1002, 1003, 1004} & set(read(single))

    pieces = pipeline.packing_stage(spark, single, folder).collect()
    total = {}
    for p in pieces:
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    assert set(total) == set(read(single)) and all(total[p["doc_id"]] == p["doc_tokens"] for p in pieces)

    assert {p["doc_id"] for p in pipeline.run(spark, folder).collect()} == set(total)


def test_stage_list():
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
