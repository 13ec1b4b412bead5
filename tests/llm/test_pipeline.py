"""The pipeline on a small table, each stage against what it must do to its own input."""

import corpus_pipeline as cp

from logvigil.llm import oddsketch


def test_stages(spark, tmp_path):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", None, 0), (10**6 + 1, "", None, "src0", 0), (10**6 + 2, "mail me at a.b@c.org", "en", "src1", 20),
                                 (10**6 + 2, "mail me at a.b@c.org", "en", "src1", 20), (None, "no id at all", "en", "src1", 12)], documents.schema)
    documents.unionByName(odd).withColumn("score", cp.F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out = cp.settled(stage(spark, docs, str(tmp_path)), name)
        if name != cp.STAGES[-1][0]:
            assert out.columns == cp.COLUMNS
        seen[name] = (docs, out)
        docs = out
    before, after = seen["minhash_near_dedup"]
    kept = sorted(r.doc_id for r in after.collect() if r.doc_id is not None)
    assert kept == sorted({r.doc_id for r in oddsketch.near_duplicates(before).collect() if r.kept and r.doc_id is not None})
    before, after = seen["pii"]
    assert before.count() == after.count() and after.filter("text LIKE '%a.b@c.org%'").count() == 0
    assert after.filter("text LIKE '%<EMAIL>%'").count() > 0 and after.filter("n_chars <> char_length(text)").count() == 0
    before, after = seen["mixing"]
    assert after.groupBy("doc_id").count().filter("count > 3 AND doc_id IS NOT NULL").count() == 0
    before, after = seen["best_fit_packing"]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_different_texts_under_one_id_stay(make):
    words = [f"w{i}" for i in range(60)]
    text, other, third = " ".join(words), " ".join(reversed(words)), " ".join(words[::2])
    rows = [(1, text, "a"), (5, text + " end", "a"), (5, text + " end", "a"), (7, other, "a"), (7, other, "a"), (7, third, "a"), (8, None, "a"), (8, None, "a"), (None, text, "b")]
    docs = make(rows)
    out = cp.one_per_group(docs.sparkSession, docs, "")
    found = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert found == sorted([(1, text), (7, other), (7, third), (8, None), (None, text)], key=str)
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("hashpartitioning(") == 2 and final.count("_digest") > 0  # the two sides of the join, nothing for the repeats


def test_empty(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
