"""Every operator and stage on awkward rows and on empty tables: defined results, no row lost."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lendscope.llm import decontamination, language_model, line_quality, mixing, pii, quality_rules, simhash_dedup, token_counts, toxicity
from lendscope.llm.common import crc_mod, scratch

from .conftest import AWKWARD

def held():
    return crc_mod("doc_id", 5) == 0



def _benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


OPERATORS = {
    "op1": lambda s, d, lab: pii.personal_data(d, pii.fit(d)),
    "op2": lambda s, d, lab: mixing.mixed(d),
    "op3": lambda s, d, lab: toxicity.toxicity(d, toxicity.fit(d, lab, ~held()), held()),
    "op4": lambda s, d, lab: quality_rules.rules(d, quality_rules.fit(d, lab)),
    "op5": lambda s, d, lab: decontamination.contaminated(d, _benchmark(s, [(1, "no such words in here at all"), (2, None), (None, "x"), (3, "")])),
    "op6": lambda s, d, lab: simhash_dedup.near_duplicates(d),
    "op7": lambda s, d, lab: token_counts.document_tokens(d, scratch(s, "tokens")),
    "op9": lambda s, d, lab: line_quality.quality(d, line_quality.fit(d, lab, ~held()), held()),
    "op10": lambda s, d, lab: language_model.scored(d, held()),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("labelled", [True, False])
def test_every_row_has_a_result(spark, awkward, labels, name, labelled):
    lab = labels([(4, 1, 0), (4, 0, 1), (6, 0, 0), (None, 1, 1), (99, 1, None), (7, 1, 0), (5, 0, 1)] if labelled else [])
    rows = OPERATORS[name](spark, awkward, lab).collect()
    key = lambda v: (v is None, v or 0)
    assert sorted((r.doc_id for r in rows), key=key) == sorted((r[0] for r in AWKWARD), key=key)
    for r in rows:
        nullable = {"doc_id", "component_id", "similarity"}
        assert all(v is not None for c, v in r.asDict().items() if c not in nullable), r


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, nothing, labels, name):
    assert OPERATORS[name](spark, nothing, labels([])).collect() == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    _benchmark(spark, [(1, "no such words in here at all"), (2, None)]).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns(spark, awkward, nothing, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, awkward, folder)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.schema.names == awkward.schema.names
        assert [f.dataType for f in out.schema] == [f.dataType for f in awkward.schema]
    else:
        assert out.columns[: len(awkward.columns)] == awkward.columns and out.columns[-2:] == ["_mix_copy", "mix_words"]
    assert out.count() <= 3 * awkward.count()
    assert out.where(F.col("score") != "x").count() == 0
    assert stage(spark, nothing, folder).count() == 0


def test_stage_results_on_awkward_rows(spark, awkward, folder):
    stages = dict(corpus_pipeline.STAGES)
    kept = [(r.doc_id, r.text) for r in stages["quality_rules"](spark, awkward, folder).collect()]
    assert all(t is not None and len(t.split()) >= 10 for _, t in kept) and len(kept) >= 4
    once = stages["simhash_near_dedup"](spark, awkward, folder)
    assert once.groupBy("text").count().where("count > 1 and text is not null").count() == 0
    assert once.where("text is null or trim(text) = ''").count() <= 1
    assert {r.doc_id for r in once.collect()} >= {1, 4, 6, 7, 8}


def test_pipeline_runs_whole(spark, documents, tmp_path):
    from .conftest import PROSE

    rows = [(i, f"{PROSE} Number {i} of many, {' '.join(f'w{i}x{j}' for j in range(30))}.", f"s{i % 2}") for i in range(40)]
    rows += [(100 + i, rows[i][1], "s0") for i in range(5)] + [(200, "write to someone@mail.example.com or ring +1 (499) 555-6503 now " + " ".join(f"q{j}" for j in range(40)), "s1")]
    item = " ".join(f"item{j}" for j in range(30))
    rows += [(300, f"{PROSE} {item} {PROSE[::-1]}", "s1"), (301, "too short", "s1")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    _benchmark(spark, [(7, item)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {300, 301, *range(100, 105)}
    text = next((r.text for r in out if r.doc_id == 200), None)
    assert text is None or ("[EMAIL]" in text and "[PHONE]" in text and "@" not in text)
