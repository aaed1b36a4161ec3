"""The pipeline's stages against what each should do to its own input."""

from collections import Counter

import corpus_pipeline
import pytest

from test_dedup import near_brute, texts_left
from test_text import base_spans, measured


@pytest.fixture(scope="module")
def steps(spark):
    from veritally.llm.common import table, written

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], "/root/testdata/sf0.001"), name))
    return out


def test_stages_keep_the_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "suffix_array_dedup", "secret_scans", "packing"]
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_each_stage_does_its_work(steps):
    before, good, single, cut, masked, packed = steps
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    for d, t in set(rows(before)) - set(rows(good)):
        n, chars, symbols, dup, repeat = measured(t)
        lines = [x for x in (t or "").split("\n") if x.strip()]
        stops = n < 50 or 2 * repeat > n or symbols > 0.1 * n or 2 * dup > len(lines) or chars > 20 * n
        assert stops or len(set((t or "").lower().split()) & {"the", "of", "der", "die", "la", "de", "que", "le"}) < 3
    _, component = near_brute(rows(good), 80)
    assert sorted(rows(single)) == sorted((d, t) for d, t in rows(good) if component[d] == d)
    assert sorted(rows(cut), key=repr) == sorted(texts_left(rows(single), corpus_pipeline.REPEATED), key=repr)
    assert any(t != dict(rows(single))[d] for d, t in rows(cut))
    assert all(r.n_chars == len(r.text) for r in masked.collect())
    assert not any(base_spans(t) for _, t in rows(masked)) and masked.count() == cut.count()
    assert {r.doc_id for r in packed.collect()} == {d for d, _ in rows(masked)}


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(map(tuple, steps[-1].select(columns).collect()))


def test_run_of_nothing(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
