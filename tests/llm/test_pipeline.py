import corpus_pipeline
from arborstream.llm import stages

from .test_jaccard import linked, shingles


def test_stages_on_edges(spark, edge, empty, tmp_path):
    labels = spark.createDataFrame([(i, i % 5 == 0) for i in range(60)], "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) as toxic", "1 as quality")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge, empty):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            n = out.count()
            assert docs is edge or n == 0


def test_one_of_each_group_stays(spark, edge):
    kept = stages.drop_near_duplicates(spark, edge, "").collect()
    sets = [(r.doc_id, shingles(r.text)) for r in kept]
    assert not any(linked(a, b) for i, (_, a) in enumerate(sets) for _, b in sets[:i])
    ids = [r.doc_id for r in kept]
    assert 1 in ids and 7 in ids and not {2, 3, 8, 9} & set(ids) and {4, 5, 6} <= set(ids)
    assert ids.count(7) == 1


def test_mixing_keeps_every_document(spark, edge):
    mixed = stages.mix_sources(spark, edge, "")
    assert {(r.doc_id, r.text) for r in mixed.collect()} == {(r.doc_id, r.text) for r in edge.collect()}
    assert mixed.count() >= edge.count()


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 100
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
