"""The pipeline's stages one by one on a small corpus."""

import random

import pytest

import corpus_pipeline
from codeloom.llm import bpe, secrets

from .test_operators import SCHEMA


@pytest.fixture()
def data(spark, tmp_path):
    r = random.Random(9)
    words = ["river", "stone", "walks", "under", "green", "light", "paper", "over", "house", "again"]
    text = lambda n: " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(n))
    rows, marks = [], []
    for i in range(120):
        t = text(60)
        if i % 4 == 0:
            t += " grumok grumar " + text(3) + " grumelt"
        rows.append((i, t))
        marks.append((i, 1, int(i % 4 == 0)))
    question = text(20)
    rows += [(201, rows[1][1]), (202, rows[2][1] + " end"), (203, question + " " + text(10)), (204, text(30) + ' token = "abcdef0123456789abcdef" ' + text(3)), (205, None), (206, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), dict(rows)


def test_stages(spark, data):
    path, texts = data
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = docs.cache()
        kept.append({r["doc_id"] for r in docs.collect()})
    bad = {i for i in range(120) if i % 4 == 0}
    assert len(bad - kept[0]) >= 25 and len((set(texts) - bad) - kept[0]) <= 2
    assert kept[0] - kept[1] == {201, 202}
    assert kept[1] - kept[2] == {203}
    assert kept[3] == kept[2]
    row = docs.where("doc_id = 204").first()
    assert "[SECRET]" in row["text"] and row["n_chars"] == len(row["text"]) and not secrets.scan_text(row["text"])
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(tokens.withColumnRenamed("tokens", "ids")).collect()}
    assert all(back[r["doc_id"]] == (r["text"] or "") for r in docs.collect())


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data[0])
    assert out.columns[0] == "doc_id" and 80 <= out.count() <= 100
