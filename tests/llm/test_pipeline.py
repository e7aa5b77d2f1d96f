"""The pipeline's stages against brute force on small tables, and its queries on the smallest fixture."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provscan.llm import registry, simhash, toxicity
from tests.llm.test_operators import ids_of, plain_fingerprint, plain_repeats, toxic_corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = toxic_corpus(400)
    shared = " ".join(f"shared{i}" for i in range(60))
    docs = [(i, f"{t} {shared}" if i % 40 == 0 else t) for i, t, _ in rows]
    docs += [(1000 + i, docs[i][1]) for i in range(5)] + [(2000, None), (2001, "")]
    root = str(tmp_path_factory.mktemp("corpus"))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    df.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages(spark, corpus):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    (_, toxic), (_, near), (_, repeats), (_, pack) = corpus_pipeline.STAGES
    columns = docs.columns
    one = toxic(spark, docs, corpus).cache()
    model = toxicity.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    assert {r["doc_id"] for r in one.collect()} == {r["id"] for r in toxicity.score(docs, model).where("score < 0.5").collect()} and one.columns == columns
    two = near(spark, one, corpus).cache()
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    marks = {i: plain_fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in marks:
        for b in marks:
            if a < b and (marks[a] ^ marks[b]).bit_count() <= 3 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"] for r in two.collect()} == {i for i in marks if find(i) == i} and two.columns == columns
    three = repeats(spark, two, corpus).cache()
    before = sorted((r["doc_id"], r["text"]) for r in two.collect())
    want = plain_repeats([t for _, t in before])
    after = {r["doc_id"]: r for r in three.collect()}
    assert three.columns == columns and sum(w[1] for w in want) > 0
    for (i, _), (n, gone, _, _) in zip(before, want):
        assert len((after[i]["text"] or "").encode()) == n - gone and (after[i]["text"] is None or after[i]["n_chars"] == len(after[i]["text"]))
    four = pack(spark, three, corpus)
    library = Tokenizer.from_file(registry.word_vocabulary())
    assert four.agg(F.sum("length")).first()[0] == sum(len(ids_of(library, r["text"])) + 1 for r in after.values())
    whole = corpus_pipeline.run(spark, corpus)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, four.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_empty_corpus(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the fixture tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_runs(spark, name):
    rows = registry.QUERIES[name](spark, SF)
    assert rows.count() > 0
    if name in registry.ORACLES:
        import duckdb

        db = duckdb.connect()
        db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
        theirs = db.sql(registry.ORACLES[name]).df()
        ours = rows.toPandas()
        key = sorted(ours.columns)
        assert ours[key].sort_values(key).values.tolist() == theirs[key].sort_values(key).values.tolist()


def test_keep_one_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "zz yy xx"), (2, "a b c d")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(df).collect())) == [(1, "a b c d"), (1, "zz yy xx")]


def test_keep_one_of_rows_without_ids_and_of_named_ids(spark):
    df = spark.createDataFrame([(None, "p q r s")] * 3 + [("b", "a b c d"), ("a", "a b c d"), (None, "a b c d"), ("c", None), (None, "")], "doc_id string, text string")
    kept = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert sorted(kept, key=str) == sorted([(None, "p q r s"), ("a", "a b c d"), ("c", None)], key=str)
    found = {(r["id"], r["component"]) for r in simhash.near_duplicates(df).collect()}
    assert found == {(None, None), ("a", "a"), ("b", "a"), (None, "a"), ("c", "c"), (None, "c")}


def test_pipeline_passes_clashing_columns_through(spark, tmp_path):
    rows = [(i, f"clean words number {i} " * 30, "en", "web", 10) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("clash") for c in ("id", "fp", "k1", "score", "values", "at", "told")})
    for name, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).count() == 30
