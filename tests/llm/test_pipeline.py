from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ondula.llm import common, decontamination, queries
from ondula.llm.simhash import fingerprint_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = queries.table(spark, SF, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(common.written(stage(spark, out[-1], SF)))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert all(s.dtypes == stages[0].dtypes for s in stages[:-1])
    assert set(stages[0].columns) <= set(stages[-1].columns)


def test_quality_keeps_good_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    kept = set(ids(stages[1]))
    good = [i for i, q in labels.items() if q]
    assert sum(i in kept for i in good) >= 0.95 * len(good)


def test_one_of_each_group(stages):
    rows = [(r.doc_id, fingerprint_of(r.text)) for r in stages[1].orderBy("doc_id").collect()]
    x = np.array([f for _, f in rows])
    i, j = np.nonzero(np.bitwise_count((x[:, None] ^ x[None]).view(np.uint64)) <= 3)
    label = common.smallest_labels(len(x), i, j)
    assert ids(stages[2]) == sorted({rows[k][0] for k in label})


def test_no_window_is_left(spark, stages):
    machine = decontamination.build([(str(r.item_id), r.text) for r in queries.table(spark, SF, "benchmark").collect()])
    assert ids(stages[3]) == sorted(r.doc_id for r in stages[2].collect() if not decontamination.scan(r.text, machine)[1])


def test_pseudonyms_keep_all_rows(stages):
    assert ids(stages[4]) == ids(stages[3])
    before = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        assert r.n_chars == len(r.text)
        assert "@" not in r.text or r.text != before[r.doc_id]


def test_mix_meets_its_targets(stages):
    total, size, target = defaultdict(int), {}, {}
    for r in stages[5].collect():
        total[r.source] += r["size"]
        size[r.source], target[r.source] = r.source_size, r.target
    longest = stages[4].select(F.max(common.word_count("text"))).first()[0]
    assert all(total[s] <= 3 * size[s] and abs(total[s] - target[s]) <= 2 * longest for s in total)


def test_run_is_the_chain_of_stages(spark, stages):
    key = ["doc_id", "epoch", "text"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*key).collect())) == sorted(map(tuple, stages[-1].select(*key).collect()))


def test_empty_documents(spark):
    docs = queries.table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


CLASH = ("n_hit", "items", "spans", "n_words", "pii", "size", "fingerprint", "component_id", "score")


def odd_documents(spark):
    """Repeated ids and rows, null and empty texts, columns named like those of the operators."""
    rows = [(1, "a long text about rivers and their banks in spring", "en", "s", 50), (1, "another text altogether with other words inside it", "en", "s", 50),
            (1, "another text altogether with other words inside it", "en", "s", 50), (2, None, None, None, None), (3, "", "de", "t", 0), (4, None, "en", None, None),
            (None, "no id but words 4111 1111 1111 1111 here", "en", "s", 40), (5, "x " * 60000 + "anna@example.com", "en", "t", 120016)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return df.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASH])


def test_odd_documents_pass_every_stage(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert all(r[c] == f"mine {c}" for r in out.collect() for c in CLASH), name
    assert sorted(r.text for r in corpus_pipeline.without_near_duplicates(spark, docs, SF).where("doc_id = 1").collect()) == sorted(
        {r.text for r in docs.where("doc_id = 1").collect()})
    texts = [r.text for r in corpus_pipeline.pseudonymous(spark, docs, SF).collect()]
    assert len(texts) == 8 and not any("4111 1111" in (t or "") or "anna@" in (t or "") for t in texts)
    assert set(docs.columns) <= set(corpus_pipeline.mixed(spark, docs, SF).columns)


def test_without_labels_all_stay(spark, monkeypatch):
    docs = odd_documents(spark)
    real = queries.table
    monkeypatch.setattr(queries, "table", lambda s, d, name: real(s, d, name).where("false") if name == "labels" else real(s, d, name))
    assert corpus_pipeline.good_quality(spark, docs, SF).count() == docs.count()
