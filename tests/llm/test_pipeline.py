import random

import corpus_pipeline
import pytest

from rentatlas.llm import chunks, packing, pii

SF = "/root/testdata/sf0.001"


def test_stages_in_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_dedup", "substring_dedup", "personal_data", "packing"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns for the small tables, written and read as the pipeline does."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = out[name] = spark.read.parquet(str(folder / name))
    return out


def test_each_stage_keeps_the_columns_and_takes_effect(stages):
    for name in ("toxicity", "near_dedup", "substring_dedup", "personal_data"):
        assert stages[name].dtypes == stages["documents"].dtypes
    rows = {k: {r.doc_id: r for r in v.collect()} for k, v in stages.items() if k != "packing"}
    assert set(rows["toxicity"]) < set(rows["documents"])
    assert set(rows["near_dedup"]) < set(rows["toxicity"])
    assert set(rows["substring_dedup"]) == set(rows["near_dedup"]) == set(rows["personal_data"])
    texts = [r.text for r in rows["near_dedup"].values()]
    assert len(texts) == len(set(texts))
    for i, r in rows["personal_data"].items():
        before = rows["substring_dedup"][i]
        spans = [s for side in pii.find(before.text) for s in side]
        assert r.text == pii.masked(before.text, spans)
        assert r.n_chars == len(r.text) and not pii.find(r.text)[0]
        assert before.n_chars == len(before.text)


def test_packing_holds_every_document(stages):
    docs = {r.doc_id: r.text for r in stages["personal_data"].collect()}
    rows = stages["packing"].collect()
    assert {r.doc_id for r in rows} == set(docs)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    for i, text in docs.items():
        assert total[i] == len(tokenizer.encode(text, add_special_tokens=False).ids) + 1


def test_run_gives_the_rows_of_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages["packing"].columns
    figures = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*figures).collect())) == sorted(
        map(tuple, stages["packing"].select(*figures).collect()))


def test_odd_documents_pass_all_stages(spark, tmp_path):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (None, "no id"), (4, "a"), (4, "a"), (4, "b")]
    rows += [(10 + i, " ".join(rng.choice("abcdefg") * 3 for _ in range(90))) for i in range(5)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    for table in (df, df.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            path = str(tmp_path / f"{name}{table is df}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.dtypes == df.dtypes
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert out.count() == (docs.count() if table is df else 0)
    assert chunks.MIN_WORDS < 50
