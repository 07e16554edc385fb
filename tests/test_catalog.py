import pytest

from gleaner.plans import catalog
from tests.conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_twin(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, SMALL), duck, catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_detection_is_mostly_right(spark):
    df = catalog.QUERIES["language_detect"](spark, "/root/testdata/sf0.01").where("lang in ('en', 'de', 'fr', 'es', 'it') and detected != 'unknown'")
    assert df.where("lang = detected").count() > 0.85 * df.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "doc_id", "rank", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_prompt_context_is_whole(spark, monkeypatch):
    shown = [("q", 1, "river", "The river. " * 1000), ("q", 2, "river", "The river. " * 3000)]
    monkeypatch.setattr(catalog, "_shown", lambda s, _: s.createDataFrame(shown, "query_id string, doc_id bigint, query string, body string"))
    got = {r.doc_id: r.context for r in catalog.QUERIES["prompt_context"](spark, SMALL).collect()}
    assert got[1] == shown[0][3].strip() and 20_000 < len(got[2]) <= 24_000
