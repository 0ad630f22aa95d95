"""The stages of the corpus pipeline, each on what the one before it kept."""

import corpus_pipeline
import plain
from conftest import DATA
from skyquill.llm.storage import components, stored


def test_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "passage_dedup", "mix", "pack"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), "test-stage")
        kept[name] = docs.collect()
        assert name == "pack" or docs.columns == columns
    texts = {x["doc_id"]: x["text"] for x in kept["language"]}
    ids = sorted(texts)
    roots = plain.groups(len(ids), plain.near_links([texts[i] for i in ids]))
    assert sorted(x["doc_id"] for x in kept["near_dedup"]) == [i for k, i in enumerate(ids) if roots[k] == k]
    left = {x["doc_id"]: x["text"] for x in kept["near_dedup"]}
    covered, _ = plain.repeated({x["doc_id"]: x["text"] for x in kept["passage_dedup"]})
    before, later = plain.repeated(left)
    assert sum(map(len, covered.values())) <= 0.02 * sum(map(len, later.values())) + 100
    assert all(x["text"] == left[x["doc_id"]] for x in kept["passage_dedup"] if x["doc_id"] not in before)
    assert sum(x["length"] for x in kept["pack"]) == sum(x["doc_tokens"] for x in kept["pack"] if x["start"] == 0)
    assert len([x for x in kept["pack"] if x["start"] == 0]) == len(kept["mix"])


def test_pipeline_of_edge_cases(spark, tmp_path):
    for n, rows in ((1, plain.edge_documents()), (2, [])):
        spark.createDataFrame(rows, plain.DOCUMENTS).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{n}").count() >= len(rows[:1])


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (103, 102), (102, 104), (7, 7)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 102, 103: 102, 104: 102}
