"""Every stage of the pipeline against plain Python on its own input."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from terrace.llm import bpe, pii, quality
from tests.llm import test_decontaminate, test_jaccard

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Rows before the first and after each stage."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    out = [frame]
    for name, stage in corpus_pipeline.STAGES:
        at = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(at)
        out.append(spark.read.parquet(at))
    return out


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_keep_the_columns(tables):
    for frame in tables[1:-1]:
        assert frame.dtypes == tables[0].dtypes


def test_quality(spark, tables):
    before, after = rows(tables[0]), rows(tables[1])
    model = quality.train(tables[0].select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    x = quality.differences([(r.text or "").encode() for r in before.values()], model.compressors())
    assert set(after) == {i for i, p in zip(before, model.score(x)) if p >= 0.7}
    assert all(after[i] == before[i] for i in after)


def test_near_duplicates(tables):
    before, after = rows(tables[1]), rows(tables[2])
    assert set(after) == test_jaccard.kept([(i, r.text) for i, r in before.items()])
    assert all(after[i] == before[i] for i in after)


def test_decontamination(spark, tables):
    before, after = rows(tables[2]), rows(tables[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {i for i, r in before.items() if not test_decontaminate.brute(r.text, items)[4]}
    assert all(after[i] == before[i] for i in after)


def test_pii(tables):
    before, after = rows(tables[3]), rows(tables[4])
    assert set(after) == set(before)
    found = re.compile(r"[\w.]+@[\w.-]+\.\w+|\d{3}-\d{2}-\d{4}")
    whole = "\n".join(r.text or "" for r in before.values())
    for i, r in after.items():
        assert r.n_chars == len(r.text)
        assert not [e for e in found.findall(r.text) if e in whole]
        if not found.search(before[i].text) and not re.search(r"\d{4}|[A-Z]\w*\. ", before[i].text):
            assert r.text == before[i].text
    assert pii.PATTERNS


def test_encoding(tables):
    before, after = rows(tables[4]), rows(tables[5])
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(after) == set(before)
    for i, r in after.items():
        assert r.round_trip and r.ids == exact.encode_ordinary(before[i].text) and r.n_tokens == len(r.ids)


def test_run_is_its_stages(spark, tables):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, tables[-1].collect()))
    assert np.array_equal(got.columns, tables[-1].columns)
