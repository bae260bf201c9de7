"""The pipeline against plain versions of its stages, and the registered queries with SQL."""

import pytest

import corpus_pipeline
from faultlens.llm import langid, pii, queries
from faultlens.llm.common import table
from tests.harness import duck, rows_of_duck, rows_of_spark
from tests.llm import brute
from tests.llm.test_dedup import components_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duck(SF)
    assert rows_of_spark(df) == rows_of_duck(con, queries.ORACLES[name])


def test_every_operator_has_a_query():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline_matches_plain_stages(spark):
    docs = table(spark, SF, "documents")
    model = langid.train(docs)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    rows = [r for r in rows if (p := model.predict(r[1]))[0] != "und" and p[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    assert len(rows) == 1000  # clean documents stay
    rows = [r for r, (i, keep, *_) in zip(rows, brute.exact_dedup(rows)) if i == keep]
    root = components_of([brute.simhash(t) for _, t in rows])
    first = {}
    for r, row in zip(root, rows):
        first.setdefault(r, row)
    rows = sorted(first.values())

    frames, frame = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns
        frame = frames[name] = frame.cache()
    assert sorted((r.doc_id, r.text) for r in frames["near"].collect()) == rows
    clean = {r.doc_id: r for r in frames["personal"].collect()}
    assert sorted(clean) == [r[0] for r in rows]
    for i, t in rows:
        new = clean[i].text
        marked = any(f"[{k.upper()}]" in new for k in pii.KINDS)
        assert brute.pii(new) == [] and clean[i].n_chars == len(new)
        assert marked == (new != t) and (marked or not brute.pii(t))
    packed = corpus_pipeline.packed(spark, frames["personal"], SF).collect()
    assert {r.doc_id for r in packed} == set(clean)


def test_stages_on_odd_rows(spark, odd):
    frame = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, frame, SF).count() >= 0
        assert stage(spark, frame.limit(0), SF).count() == 0
