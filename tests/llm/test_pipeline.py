import os
import random
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.samples import odd_documents
from tests.llm.test_repeats_and_joins import brute_groups, brute_hits, brute_passages
from veritab.llm import op7_suffix_dedup as op7
from veritab.llm.common import ending, sliced, tokenizer_path
from veritab.llm.encoding import encoder

SF = "/root/testdata/sf0.01"


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    items = spark.createDataFrame([(1, "zz " * 12)], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i == 3)) for i in range(1, 14)], "doc_id long, quality int, toxic int")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_documents(spark, [(50, "x " + "zz " * 12)]), odd_documents(spark).filter("false")):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == pipeline.COLUMNS
                docs = pipeline.stored(out, name)
            else:
                out.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")
def test_stages_against_brute_force(spark):
    """Each stage is judged on its own input."""
    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    def texts(df):
        return {r.doc_id: r.text or "" for r in df.collect()}

    before = texts(docs)
    docs = pipeline.stored(stages["toxicity"](spark, docs, SF), "t")
    after = texts(docs)
    gone = set(before) - set(after)
    assert all(after[d] == before[d] for d in after)
    assert sum((d in gone) == bool(y) for d, y in labels.items()) / len(labels) > 0.97

    before = after
    docs = pipeline.stored(stages["jaccard_join"](spark, docs, SF), "j")
    after = texts(docs)
    sets, ids = [], sorted(before)
    for d in ids:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in before[d]).split()
        sets.append({tuple(w[i: i + 5]) for i in range(max(len(w) - 5, 0) + 1)} if w else set())
    assert set(after) == {ids[g] for i, g in enumerate(brute_groups(sets, (80, 100))) if g == i}

    before = after
    docs = pipeline.stored(stages["suffix_dedup"](spark, docs, SF), "s")
    after = texts(docs)
    order = sorted(before)
    assert [after[d] for d in order] == brute_passages([before[d] for d in order])
    assert all(r.n_chars == len(r.text) for r in docs.filter(F.col("text").isNotNull()).collect())

    before = after
    docs = pipeline.stored(stages["decontamination"](spark, docs, SF), "d")
    after = texts(docs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) <= set(before)
    sample = sorted(set(before) - set(after)) + sorted(after)[:40]
    assert all((brute_hits(before[d], items)[1] > 0) == (d not in after) for d in sample)
    assert stages["packing"](spark, docs, SF).select(F.countDistinct("doc_id")).first()[0] == len(after)


@pytest.mark.parametrize("bucket", [op7.BUCKET_BYTES, 300])
def test_passages_of_over_50_words_are_cut(spark, monkeypatch, bucket):
    """51 words repeat in fewer than 400 bytes; 50 words stay."""
    rnd = random.Random(51)
    fresh = lambda n: [f"{rnd.randrange(10**4)}" for _ in range(n)]
    short, passage, wide = fresh(50), fresh(51), fresh(70)
    assert len(" ".join(wide).encode()) < 400
    texts = [" ".join(fresh(rnd.randrange(80)) + p + fresh(rnd.randrange(80))) for p in (short, passage, wide) for _ in range(6)]
    texts += ["\n".join(["été", *passage, "x"]), " ".join(passage), " ".join(["zz"] * 60), "one " * 51, "漢字" * 80, "漢字" * 80, "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], pipeline.DOCUMENTS).repartition(3)
    monkeypatch.setattr(op7, "BUCKET_BYTES", bucket)  # 300 units: windows under a hot hash are counted
    got = {r.doc_id: r.text for r in pipeline.suffix_dedup(spark, docs, "").collect()}
    assert [got[i] or "" for i in range(len(texts))] == brute_passages(texts)
    assert got[0] == texts[0] and len(got[6].split()) == len(texts[6].split()) - 51
    assert got[len(texts) - 1] is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")
def test_passages_of_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(rows)
    got = {r.doc_id: r.text for r in pipeline.suffix_dedup(spark, docs, SF).collect()}
    assert [got[d] for d in order] == brute_passages([rows[d] for d in order])


def test_workers_import_no_more_than_they_need():
    """Workers import the modules of their functions; Spark's classifiers and pandas took 30 MB in each."""
    code = "import sys, corpus_pipeline; print(sorted({'pandas', 'pyspark.ml'} & set(sys.modules)))"
    env = os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout.strip() == "[]"


def test_tasks_of_other_stages_drop_the_encoder():
    batch = pa.RecordBatch.from_pydict({"text": ["one two", None, "three"]})
    for other in (sliced, ending):
        encoder(tokenizer_path())
        assert sum(len(b) for b in sliced(iter([batch]), remember=True)) == 3
        assert encoder.cache_info().currsize == 1
        assert sum(len(b) for b in other(iter([batch]))) == 3
        assert encoder.cache_info().currsize == 0


def test_stages_ask_for_small_batches(spark):
    """A setting of the session's own stays."""
    spark = spark.newSession()
    pipeline.ship(spark)
    pipeline.lean(spark)
    assert spark.conf.get(pipeline.ARROW_BATCH) == pipeline.STAGE_BATCH and spark.conf.get(pipeline.READER_ROWS) == pipeline.STAGE_ROWS
    spark.conf.set(pipeline.ARROW_BATCH, "2097152b")
    spark.conf.set(pipeline.READER_ROWS, "100")
    pipeline.lean(spark)
    assert spark.conf.get(pipeline.ARROW_BATCH) == "2097152b" and spark.conf.get(pipeline.READER_ROWS) == "100"
