from pyspark.sql import functions as F

import corpus_pipeline
from lodestore.llm import decontam, packing, secrets, simhash, toxicity


def brute_groups(texts):
    """The smallest id of each group of near copies, over all pairs."""
    sets = {d: set(simhash.shingle_hashes(t).tolist()) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if not x and not y or len(x & y) >= 0.8 * len(x | y):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {find(d) for d in ids}


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    """Each stage against its operator's own decisions, taken from its digest."""
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    docs = table("documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.score_documents(docs, table("labels")).where("predicted = 0").collect()}
        elif name == "simhash_near_dedup":
            want = set(brute_groups(before))
        elif name == "benchmark_decontamination":
            want = set(before) - {r.doc_id for r in decontam.find_leaks(docs, table("benchmark")).collect()}
            items = [r.text for r in table("benchmark").collect()]
            assert not any(i in before[d] for d in ids for i in items)
        elif name == "secret_scan":
            want = set(before)
            assert secrets.secret_digest(out).agg(F.sum("n_hex") + F.sum("n_access")).first()[0] == 0
            marked = {r.doc_id for r in out.where("text like '%[SECRET]%'").collect()}
            assert marked == {r.doc_id for r in secrets.secret_digest(docs).where("spans <> ''").collect()}
        else:
            want = set(before)
            assert packing.pack(docs).count() == out.count()
        assert ids == want and want
        docs = out


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["bin_id", "doc_id", "piece", "start_token", "n_tokens", "residual"] and out.count() > 100


def tables(spark, folder, docs, items, labels):
    """A folder of tables as a query gets it."""
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_nulls_repeats_and_extra_columns(spark, edge, tmp_path, prose):
    """All stages over null ids, texts and columns, empty and long texts, repeated rows, and columns named like an operator's own."""
    odd = edge.withColumn("row", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("text_key", F.lit(2)).withColumn("_salt", F.lit(3)).withColumn("a.b", F.lit(4))
    leak = prose(77, 30)
    more = [(20, f"{prose(21)} {leak} {prose(22)}"), (21, f"{prose(23)} token = 'abcdefgh' {prose(24)}"), (None, f"{prose(25)} {leak}")]
    odd = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    folder = tables(spark, tmp_path, odd, [(1, leak), (None, None)], [(1, 1, 0), (2, 0, 1), (None, None, None), (7, 1, 0), (7, 1, 0)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        assert docs.columns == odd.columns, name
    left = [(r.doc_id, r.text) for r in docs.collect()]
    ids = [d for d, _ in left]
    assert ids.count(1) == 1 and ids.count(7) == 0 and 20 not in ids  # 7 repeats 1; 20 holds an item
    assert ids.count(2) == 1 and not {3, 4} & set(ids)  # texts without words are copies of each other
    assert not any(leak in (t or "") for _, t in left) and ids.count(None) == 2
    assert "[SECRET]" in dict(left)[21] and "abcdefgh" not in dict(left)[21]
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == set(ids)


def test_empty_tables(spark, empty, tmp_path):
    folder = tables(spark, tmp_path, empty, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
