"""The pipeline's stages in turn."""

import corpus_pipeline
from tests.conftest import SMALL
from tidemark.llm.decontamination import find_items


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mixture", "shards"]
    assert all(df.columns == columns for name, df in kept.items() if name != "shards")
    assert before > kept["quality"].count() > kept["near_duplicates"].count() >= kept["decontaminate"].count()
    assert find_items(kept["decontaminate"], spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
    assert kept["decontaminate"].join(kept["mixture"], "doc_id", "left_anti").count() == 0
    assert kept["shards"].count() == kept["mixture"].count()
    assert corpus_pipeline.run(spark, SMALL).count() == kept["shards"].count()


def _tables(spark, hard, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "zq"), (4, "one two three four")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_hard_rows_through_all_stages(spark, hard, tmp_path):
    """Nulls, empties, ties, copies, long texts, odd blanks and clashing columns, in each stage and in all in turn."""
    folder = _tables(spark, hard, tmp_path, hard, [(i, i % 2, 0) for i in range(20, 50)] + [(None, 1, 0)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        kept[name] = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
        assert name == "shards" or out.columns == docs.columns
    before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert all(len((t or "").split()) >= 20 for _, t in kept["quality"])
    assert {1, 2, 3, 4, 7} <= {d for d, _ in kept["near_duplicates"]} and not {8, 9} & {d for d, _ in kept["near_duplicates"]}
    assert {d for d, _ in before} - {d for d, _ in kept["decontaminate"]} == {5, 6}
    assert set(kept["mixture"]) == set(before) and sorted(map(str, kept["shards"])) == sorted(map(str, before))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(len(r.text.split()) >= 20 and 0 <= r.shard < 8 for r in rows)
    assert set(hard.columns) <= set(rows[0].asDict())


def test_empty_tables_through_all_stages(spark, hard, nothing, tmp_path):
    folder = _tables(spark, hard, tmp_path, nothing.coalesce(1), [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0
