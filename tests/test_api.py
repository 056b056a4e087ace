from pyspark.sql import functions as F

from lodestore import api


def test_ingest_and_consolidate(spark):
    files = spark.createDataFrame([("a.txt", "> first question\nlong enough answer about a database\n> second question here\nanother reply about code\n> third one\nyes, a reply"), ("b.md", "A paragraph that is long enough to be kept.\n\nshort"), ("c.md", "known already, and long enough to be kept")], "file string, content string")
    known = spark.createDataFrame([("c.md",)], "file string")
    chunks = api.ingest_conversations(files, known)
    got = {(r.file, r.chunk_index): r.room for r in chunks.collect()}
    assert {f for f, _ in got} == {"a.txt", "b.md"} and got[("a.txt", 0)] == "technical" and got[("b.md", 0)] == "general"

    def extract(pdf):
        return pdf.assign(type="semantic", title=pdf["content"].str[:20], body=pdf["content"], retention_score=pdf["content"].str.contains("database").map({True: 0.9, False: 0.1}))[["type", "title", "body", "retention_score"]]

    kept = api.consolidate(chunks, extract, "type string, title string, body string, retention_score double").collect()
    assert len(kept) == 1 and kept[0].speaker_role == "user"


def test_build_atlas_assigns_every_vector(spark):
    v = spark.createDataFrame([(i, [1.0 if j == i % 8 else 0.01 for j in range(8)]) for i in range(48)], "id int, vec array<double>")
    cards, assigned = api.build_atlas(v, seed=1, rounds=5)
    assert cards.count() == 9 and assigned.count() == 48
    assert cards.agg(F.sum("memory_count")).first()[0] == 48


def test_forget_and_curate(spark):
    m = spark.createDataFrame([(i, "t", 1, i, 0, 0.5, 1000 + i) for i in range(30)], "seq long, tenant_id string, primary_anchor_id int, pack_count long, select_count long, quality_score double, created_s long")
    assert sorted(r.seq for r in api.forget(m, 10_000_000, 20).collect()) == list(range(10))
    assert api.forget(m, 10_000_000, 20, 25).count() >= 10
    pool = spark.createDataFrame([(1, 0, "how do graph databases scale")], "anchor_id int, n int, query string")
    have = spark.createDataFrame([(1, "graph databases scale")], "anchor_id int, pattern string")
    new = {r.pattern for r in api.curate(pool, have).collect()}
    assert "how do graph databases scale" in new and len([p for p in new if p == "graph databases scale"]) == 1
