"""The pipeline against its stages applied by hand, and the queries' SQL, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from llm import nearset, quality, queries, toxicity
from llm.common import split_of

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], DATA).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    ids = [Counter(r["doc_id"] for r in x.select("doc_id").collect()) for x in kept]
    assert all(x.columns == docs.columns for x in kept[:5])
    # Filters, against scores of the same models.
    for k, (module, good) in enumerate([(quality, lambda s: s >= 0.7), (toxicity, lambda s: s < 0.3)]):
        model = module.train(kept[k], labels, split_of("doc_id", 4) != 2)
        scores = {r["doc_id"]: r["score"] for r in module.with_score(kept[k], model).collect()}
        assert set(ids[k + 1]) == {i for i, s in scores.items() if good(s)}
    # One document of each group, against brute-force groups.
    from test_training_operators import brute_components

    groups = brute_components([(r["doc_id"], r["text"]) for r in kept[2].collect()])
    assert set(ids[3]) == {g for _, g in groups.values()} and max(ids[3].values()) == 1
    # Repeats of at most three, and every token packed once per repeat.
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 3
    packed = Counter()
    for r in kept[5].collect():
        packed[r["doc_id"]] += r["length"]
    sizes = {r["doc_id"]: r["doc_tokens"] for r in kept[5].collect()}
    assert packed == Counter({i: n * sizes[i] for i, n in ids[4].items()})
    assert corpus_pipeline.run(spark, DATA).count() == kept[5].count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "embeddings"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    frame = queries.queries()[name](spark, DATA)
    wanted = connection.sql(queries.oracle_sql()[name])
    order = [wanted.columns.index(c) for c in frame.columns]
    assert sorted(map(tuple, frame.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in wanted.fetchall()), key=str)


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    for name, label, least in (("op8_quality", "quality", 0.95), ("op4_toxicity", "toxic", 0.85)):
        found = {r["doc_id"]: r["predicted"] for r in queries.queries()[name](spark, data).where("held_out").collect()}
        truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r["doc_id"] in found}
        assert sum(found[i] == y for i, y in truth.items()) >= least * len(truth)
    found = {r["doc_id"]: r["lang_pred"] for r in queries.queries()["op9_language"](spark, data).where("held_out").collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r["doc_id"] in found}
    assert sum(found[i] == y for i, y in truth.items()) >= 0.98 * len(truth)


def test_components_of_nothing(spark):
    assert nearset.near_sets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
