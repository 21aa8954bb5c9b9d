"""The pipeline on a small corpus: each stage against what its operator says, and the whole against the library."""

import corpus_pipeline as cp
import public_tokenizers
import pytest
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def folder(prose, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    for name, df in zip(("documents", "labels"), prose):
        df.coalesce(2).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_stages(spark, prose, folder):
    docs, labels = prose
    marks = {r.doc_id: r for r in labels.collect()}
    assert [k for k, _ in cp.STAGES] == ["quality", "toxicity", "near_dedup", "mix", "encode"]
    good = cp.good_quality(spark, docs, folder)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, m in marks.items() if m.quality}
    clean = cp.not_toxic(spark, good, folder)
    assert {r.doc_id for r in clean.collect()} == {i for i, m in marks.items() if m.quality and not m.toxic}
    single = cp.no_near_copies(spark, clean, folder)
    ids = {r.doc_id for r in single.collect()}
    assert single.columns == docs.columns and not ids & set(range(5, 400, 20)) and not ids & set(range(8, 400, 20))
    mixed = cp.mixed(spark, single, folder)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= ids


def test_run(spark, folder):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = cp.run(spark, folder).collect()
    assert rows
    for r in rows:
        assert r.ids == lib.encode(text[r.doc_id], add_special_tokens=False).ids and r.decoded == lib.decode(r.ids, skip_special_tokens=False)


def test_stages_take_odd_rows(spark, odd, none, folder):
    for df in (odd, none):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, df, folder)
            assert out.columns == df.columns
            out.collect()
        assert cp.encoded(spark, df, folder).count() == df.count()
