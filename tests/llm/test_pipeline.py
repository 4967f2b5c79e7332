"""The pipeline's stages on the edge table, each against what its operator says of the stage's input."""

from collections import Counter

import pytest

import corpus_pipeline
from tessella.llm import decontaminate, lines, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    at, docs, out = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        after.write.parquet(str(at / name))
        after = spark.read.parquet(str(at / name))
        out.append((docs, after))
        docs = after
    return dict(zip((n for n, _ in corpus_pipeline.STAGES), out))


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_filters_keep_rows_as_they_are(steps):
    before, after = steps["quality"]
    assert not texts(after) - texts(before) and after.count() > 0.7 * before.count()
    assert after.columns == before.columns


def test_lines_go_as_decided(steps):
    before, after = steps["line_dedup"]
    gone = {r.doc_id: {d.line for d in r.dropped} for r in lines.fuzzy_lines(before).collect()}
    wanted = Counter((r.doc_id, "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in gone[r.doc_id])) for r in before.collect())
    assert texts(after) == wanted and sum(map(len, gone.values())) > 0


def test_one_document_of_a_group_stays(steps):
    before, after = steps["near_dedup"]
    groups = {r.component_id for r in simhash.near_duplicates(before).collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter(groups) and not texts(after) - texts(before)


def test_no_benchmark_window_is_left_in_place(spark, steps):
    before, after = steps["decontamination"]
    hit = {r.doc_id: r.n_hit for r in decontaminate.match_items(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    clean = texts(before.where(before.doc_id.isin([k for k, n in hit.items() if not n])))
    assert not clean - texts(after) and all(n == 0 or (k, t) not in texts(after) for (k, t) in texts(before) for n in [hit[k]])


def test_tokens_decode_to_the_texts(steps):
    import hashlib

    before, after = steps["byte_bpe"]
    assert Counter((r.doc_id, r.decoded_sha256) for r in after.collect()) == Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in before.collect())


def test_edge_rows_pass_every_stage(spark, docs, no_docs):
    for source in (docs, no_docs):
        now = source.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, now, SF)
            assert kept.columns == now.columns
            now = spark.createDataFrame(kept.collect(), now.schema)
        assert corpus_pipeline.to_tokens(spark, now, SF).count() == now.count()
