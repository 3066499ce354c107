"""Texts without an entity are searched once, not again for rewriting."""

from feedloom.llm import surrogates
from feedloom.llm.common import ready


def test_clean_texts_are_not_searched_again(spark):
    rows = [(i, f"plain words number {i}") for i in range(200)] + [(200, "write to ann.lee@mail8.example now"), (201, None), (202, ""), (None, "plain")]
    out = surrogates.replace_entities(ready(spark).createDataFrame(rows, "doc_id bigint, text string"), b"key")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    branches = plan.split("\n:- ")
    assert any("MapInArrow" not in b for b in branches[1:]) and plan.count("MapInArrow") == 2
    got = {r["doc_id"]: (r["n_entities"], r["text"]) for r in out.collect()}
    assert len(got) == len(rows) and got[201] == (0, None) and got[202] == (0, "") and got[None] == (0, "plain")
    assert all(got[i] == (0, f"plain words number {i}") for i in range(200))
    assert got[200][::-1] == surrogates.rewritten(rows[200][1], b"key", {}) and got[200][0] == 1
