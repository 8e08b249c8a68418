"""Registered queries on the given tables: SQL where there is some, and the pipeline against its parts."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import compare, connect  # noqa: E402

from sitesignal.llm.queries import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLE[name], SF) is None


def test_pipeline(spark):
    import corpus_pipeline

    from sitesignal.llm import pieces
    from sitesignal.llm.queries import tokenizer_file

    larger = "/root/testdata/sf0.01"  # 200 texts are too few for the likelihood ratio to tell all junk
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mixing", "piece_encoding"]
    got = corpus_pipeline.run(spark, larger)
    texts = dict(spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text").collect())
    bad = {r.doc_id for r in spark.read.parquet(f"{larger}/labels.parquet").filter("quality = 0").collect()}
    rows = got.collect()
    vocabulary = pieces.Pieces(tokenizer_file("piece_bpe_32k.model"))
    assert rows and not bad & {r.doc_id for r in rows}
    assert all(vocabulary.decode(r.ids) == texts[r.doc_id] for r in rows)
    kept = [texts[i].split() for i in {r.doc_id for r in rows}]
    assert len({" ".join(w) for w in kept}) == len(kept)


def test_pipeline_on_the_smallest_table(spark):
    import corpus_pipeline

    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    rows = corpus_pipeline.run(spark, SF).select("doc_id").collect()
    assert rows and not bad & {r.doc_id for r in rows}


def test_pipeline_encodes_the_n_best_segmentations(spark):
    import corpus_pipeline
    from sitesignal.llm import pieces
    from sitesignal.llm.queries import tokenizer_file

    texts = {1: "a handful of words is enough for several segmentations", 2: "", 3: None}
    docs = spark.createDataFrame([(i, "en", "web", t) for i, t in texts.items()], "doc_id long, lang string, source string, text string")
    rows = {r.doc_id: r for r in corpus_pipeline.piece_encoding(spark, docs, SF).collect()}
    vocabulary = pieces.Pieces(tokenizer_file("piece_bpe_32k.model"))
    want = pieces.Encoder(vocabulary, pieces.N_BEST).encode([texts[1]])[0]
    assert [tuple(x) for x in rows[1].segmentations] == [tuple(ids) for _, ids in want] and len(want) == pieces.N_BEST > 1
    assert rows[1].scores == [s for s, _ in want] and rows[1].ids == rows[1].segmentations[0] and rows[1].score == rows[1].scores[0]
    assert {vocabulary.decode(ids) for ids in rows[1].segmentations} == {texts[1]}
    assert all(rows[i].segmentations == [[]] and rows[i].ids == [] for i in (2, 3))


def test_encoding_tasks_leave_no_words_in_their_worker(monkeypatch):
    import pyarrow as pa
    from pyspark.sql.types import StructType

    from sitesignal.llm import pieces
    from sitesignal.llm.queries import tokenizer_file

    class Docs:
        columns, schema = ["text"], StructType().add("text", "string")

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    monkeypatch.setattr(pieces, "BATCH_CHARS", 200)
    texts = [f"words of text {i}" for i in range(40)] + [None, "é" * 500, ""]
    path = tokenizer_file("piece_bpe_32k.model")
    batch = pa.RecordBatch.from_arrays([pa.array(["before", *texts]).slice(1)], ["text"])
    parts = list(pieces.encoded(Docs(), path, 2).run(iter([batch, batch.slice(0, 0)])))
    assert len(parts) > 5 and [t for p in parts for t in p["text"].to_pylist()] == texts
    encoder = pieces._encoder(path, 2, pieces.ROWS_SHARE)
    assert not encoder.row and not encoder.searched and not encoder.remembered()


def test_pipeline_bounds_what_its_last_step_holds(spark, tmp_path):
    """The rows of a stage are computed and written after it has returned: in small batches, and in row groups that end before 100 long rows are held."""
    import corpus_pipeline
    import pyarrow.parquet as pq

    from sitesignal import session

    names = [*session.LONG_ROWS]
    before = {k: spark.conf.get(k, None) for k in names}
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k}" for k in range(4000)), "en", "a") for i in range(20)], "doc_id long, text string, lang string, source string").coalesce(1)
    try:
        for k in names:
            spark.conf.unset(k)
        spark.conf.set("parquet.block.size", str(1 << 16))
        dict(corpus_pipeline.STAGES)["piece_encoding"](spark, docs, "").write.parquet(str(tmp_path / "out"))
        assert [spark.conf.get(k) for k in names] == [session.RECOMMENDED[session.BATCH_ROWS], str(session.PAGE_BATCH_BYTES), "1", str(1 << 16)]
        (part,) = (tmp_path / "out").glob("*.parquet")
        assert pq.ParquetFile(part).metadata.num_row_groups >= 5
        spark.conf.unset("parquet.block.size")
        with session.long_rows(spark):
            assert spark.conf.get("parquet.block.size") == session.LONG_ROWS["parquet.block.size"]
        assert spark.conf.get("parquet.block.size", None) is None
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_pipeline_bounds_what_python_holds(spark):
    """Steps hand rows to Python in bounded batches, and the quality rules send a text once."""
    import corpus_pipeline

    from sitesignal import session
    from sitesignal.llm import quality

    seen = corpus_pipeline._tidy(lambda s, docs, sf_dir: [s.conf.get(k, None) for k in (session.BATCH_ROWS, session.BATCH_BYTES)])(spark, None, "")
    assert seen == [session.RECOMMENDED[session.BATCH_ROWS], str(session.PAGE_BATCH_BYTES)]
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60))), (2, None), (3, "w1 w2")], "doc_id long, text string")
    kept = quality.keep_good(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert [tuple(r) for r in kept.collect()] == [tuple(docs.first())]
    plan = kept._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow run(row" in plan and "text#" not in plan.split("MapInArrow run(row")[1].split("\n")[0], plan
    assert [r.doc_id for r in quality.keep_good(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), text_col="TEXT").collect()] == [1]
