import hashlib

import public_tokenizers
import pytest

import corpus_pipeline as pipeline
from subsidia.llm import decontaminate, language_id
from subsidia.llm.common import materialise
from tests.llm.messy import documents
from tests.llm.test_minhash import brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        out.append((name, before, docs))
    return out


def test_stages_keep_the_columns(stages):
    assert [s[0] for s in stages] == ["language_id", "near_duplicates", "decontaminate", "encode"]
    assert all(set(after.columns) == {"doc_id", "text", "lang", "source", "n_chars"} for _, _, after in stages[:-1])


def test_languages_keep_prose(stages):
    _, before, after = stages[0]
    gone = before.join(after, "doc_id", "left_anti").collect()
    assert len(gone) <= 0.02 * before.count()
    model = language_id.fit(before.withColumnRenamed("doc_id", "key"))
    assert {r.doc_id for r in gone} == {r.doc_id for r in language_id.predict(before, model).where("rejected").collect()}


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    want = {i for i, (_, root) in brute([(r.doc_id, r.text) for r in before.collect()]).items() if i == root}
    assert {r.doc_id for r in after.collect()} == want


def test_nothing_of_the_benchmark_stays(spark, stages, sf_dir):
    _, before, after = stages[2]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held = {r.doc_id for r in decontaminate.leaks(before, bench).collect()}
    assert held and {r.doc_id for r in before.collect()} - held == {r.doc_id for r in after.collect()}


def test_texts_are_encoded(stages):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    _, before, after = stages[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert len(texts) == after.count()
    for r in after.collect():
        ids = lib.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), lib.decode(ids))))


def test_messy_and_empty_documents(spark, tmp_path):
    spark.createDataFrame([(1, "some benchmark text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    documents(spark, True).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id or 0, r.n_tokens > 0) for r in pipeline.run(spark, str(tmp_path)).collect())
    # without letters (1, 2, 3, 9, null), copies (5 twice, 6, 8); the model has learnt these very texts
    assert got == [(0, True), (4, True), (5, True), (5, True), (7, True), (10, True), (11, True)]
    documents(spark, True).limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
