import corpus_pipeline
from tests.llm.fixtures import SCHEMA, folder, rows
from tests.llm.test_jaccard_join import brute
from tests.llm.test_decontaminate import ITEMS
from tests.llm.test_secrets import planted


def test_stages(spark, tmp_path):
    leak = (700, rows()[5][1] + "\n" + ITEMS[0][1], "en", "s", 0)
    secret, _ = planted()
    data = rows() + [leak] + secret
    path = folder(spark, tmp_path, data, ITEMS[:2])
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    known = [r for r in data if r[1] and any(c.isalpha() for c in r[1])]
    want = {i for i, (_, c) in brute(known).items() if i == c} - {700} | {None}
    assert set(out) == want
    assert all("<SECRET>" in out[r[0]].text for r in secret)
    assert all(r.round_trip and r.n_chars == len(r.text) for r in out.values())


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    path = folder(spark, tmp_path, None, ITEMS[:2])
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, path).columns == docs.columns, name


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], ITEMS)).count() == 0
