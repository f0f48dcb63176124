"""The text queries: against SQL where there is one; ids against the library."""

import pytest

from tests.compare import same
from tidewright.llm.queries import R
from tidewright.llm.tokens import TOKENIZER, tokenizer


@pytest.mark.parametrize("name", list(R.queries))
def test_query(spark, data, duck, name):
    df = R.queries[name](spark, data)
    if name in R.sql:
        same(df, duck, R.sql[name])
    else:
        assert df.count() > 0


def test_ids_equal_the_library(spark, data, duck):
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    got = {r.doc_id: r.ids for r in R.queries["p7_ids"](spark, data).collect()}
    assert got == {k: tokenizer(TOKENIZER).encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}


def test_shares_are_reached(spark, data):
    rows = R.queries["p8_shares"](spark, data).collect()
    assert abs(sum(r.reached_share for r in rows) - 1) < 1e-9


def test_kept_and_found_are_complements(spark, data):
    found = {r.doc_id for r in R.queries["p9_found"](spark, data).collect()}
    kept = {r.doc_id for r in R.queries["p9_kept"](spark, data).collect()}
    assert not found & kept and len(found | kept) == spark.read.parquet(f"{data}/documents.parquet").count()
