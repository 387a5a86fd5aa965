"""The stages of the corpus pipeline against brute force."""

from __future__ import annotations

import pandas as pd
import pytest
from conftest import SF_DIR
from test_operators import brute_dedup, brute_links

import corpus_pipeline as p
from sievework.llm.common import materialize


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in p.STAGES:
        out.append(materialize(stage(spark, out[-1], SF_DIR)))
    return [x.toPandas() for x in out]


def test_columns_and_names(stages):
    assert [n for n, _ in p.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    assert all(list(x.columns) == list(stages[0].columns) for x in stages[1:-1])


def test_clean_documents_stay(stages):
    labels = pd.read_parquet(f"{SF_DIR}/labels.parquet").set_index("doc_id").quality
    good, bad = set(labels[labels == 1].index), set(labels[labels == 0].index)
    kept = set(stages[2].doc_id)
    assert len(good & kept) >= 0.97 * len(good)
    assert len(bad & kept) <= 0.2 * len(bad)


def test_one_of_each_group_stays(stages):
    want = {i for i, f in brute_links(list(zip(stages[2].doc_id, stages[2].text))).items() if f[4] == i}
    assert set(stages[3].doc_id) == want


def test_repeats_go(stages):
    want = brute_dedup(list(zip(stages[3].doc_id, stages[3].text)))
    got = stages[4].set_index("doc_id")
    assert {i: t for i, t in got.text.items()} == {i: w[2] for i, w in want.items()}
    assert (got.n_chars == got.text.str.len()).all()


def test_every_document_is_packed(stages, spark):
    assert set(stages[5].doc_id) == set(stages[4].doc_id)
    assert len(p.run(spark, SF_DIR).toPandas()) == len(stages[5])


def test_pipeline_of_nothing_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(None, "some words of a text", None, None, None), (7_000_000, None, "en", "s", 0), (7_000_001, "", None, "s", 0)], docs.schema)
    for rows in (docs.where("false"), docs.unionByName(odd)):
        for _, stage in p.STAGES:
            rows = materialize(stage(spark, rows, SF_DIR))
        rows.count()


@pytest.mark.parametrize("at", range(5))
def test_stages_give_back_memory_first(monkeypatch, at):
    """The pipeline's heaps grew from stage to stage, beside workers, beyond an executor's memory."""

    class Released(Exception):
        pass

    def release(spark):
        raise Released

    monkeypatch.setattr(p, "release", release)
    with pytest.raises(Released):
        p.STAGES[at][1](None, None, SF_DIR)
