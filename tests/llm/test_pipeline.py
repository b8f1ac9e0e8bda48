import corpus_pipeline
from tracelake.llm import decontamination, near_dedup, packing, quality_rules, suffix_dedup


def test_stages_follow_each_other(spark, sf):
    """run() equals the stages applied one by one to collected rows, each checked by its own tests."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kind = docs.schema
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == kind.names
        docs = spark.createDataFrame(out.collect(), kind)
    want = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pack(docs).collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_stages_are_the_dealt_ones():
    assert [f for _, f in corpus_pipeline.STAGES] == [quality_rules.keep_good, near_dedup.keep_one, suffix_dedup.drop_repeats, decontamination.drop_leaks, packing.pack_stage]


def test_run_on_odd_and_empty_tables(spark, sf, make_docs, odd_texts, tmp_path):
    """Null and empty texts, repeated rows, null ids and columns with names of the stages go through all stages; so does an empty table."""
    import random

    rng = random.Random(4)
    good = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and len(r.text.split()) > 80][:12]
    docs = make_docs([*odd_texts, *good, " ".join(rng.choice(good).split()[:70])])
    docs = docs.union(docs.filter("doc_id = 11")).selectExpr("nullif(doc_id, 12) as doc_id", "text", "lang", "source", "n_chars", "1 as node", "2 as _kept", "3 as _quality")
    for name, rows in (("odd", docs), ("none", docs.limit(0))):
        folder = tmp_path / name
        rows.write.parquet(str(folder / "documents.parquet"))
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(folder / f"{t}.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        ids = [r.doc_id for r in out]
        assert len(out) == len({(r.doc_id, r.piece) for r in out})  # a repeated row is one document
        assert all(i is None or i >= len(odd_texts) for i in ids) and (bool(ids) == (name == "odd"))
