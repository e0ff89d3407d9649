"""The tool surface on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from ferrule.explorer import Explorer


@pytest.fixture(scope="module")
def x(spark, small):
    return Explorer(spark, small)


def test_lookups_agree(x):
    one = x.elements.where("element_type = 'method'").orderBy("element_id").first()
    e = one["element_id"]
    digest = x.elements.where(F.col("element_id") == e).select(F.sha2("element_id", 256)).first()[0]
    assert x.get_element(e).count() == 1 and x.get_element(digest).first()["element_id"] == e and x.get_element(digest[:20]).count() == 1
    with pytest.raises(ValueError, match="more than one"):
        x.get_element("a")
    got = x.batch_get_elements([e, "none", e]).collect()
    assert [(r["element_id"], r["row_id"] is None) for r in got] == [(e, False), ("none", True), (e, False)]
    assert any(r["relation"] == "self" for r in x.get_context(e).select("relation").collect())
    assert x.get_file_structure(one["relative_path"]).count() > 0


def test_searches(x, spark, small):
    n = x.pattern_search("return", include_tests=True).count()
    assert n == x.elements.where("raw_code RLIKE 'return' AND length(raw_code) <= 8191").count() and x.pattern_search("RETURN", "wildcard").count() <= n
    assert x.pattern_search("return the", "proximity", glob="src/*").count() >= 0
    with pytest.raises(ValueError, match="mode"):
        x.pattern_search("x", "other")
    v = x.elements.where("size(summary_embedding) = 64 AND NOT exists(summary_embedding, e -> isnan(e))").orderBy("element_id").first()
    near = x.find_similar(v["element_id"], limit=5).collect()
    assert len(near) == 5 and v["element_id"] not in {r["element_id"] for r in near}
    assert x.search_vector(v["summary_embedding"], limit=1).first()["score"] == pytest.approx(1, abs=1e-5)
    assert x.search_text("registry path").count() > 0 and x.find_files("*.py").count() > 0


def test_graph_and_quality(x):
    c = x.calls.first()
    if c:
        assert c["element_id"] in {r["element_id"] for r in x.find_callers(c["target"]).select("element_id").collect()}
        assert x.find_call_chain(c["element_id"], max_depth=2).where("depth = 1").count() >= 1
        assert x.explain_element(c["element_id"]).where("relation = 'callee'").count() >= 1
    for df in (x.find_dead_code(), x.find_entry_points(), x.find_usages("log"), x.find_implementations("Base"), x.find_dependencies("src/utils.py"), x.find_dependents("./x"), x.dependency_graph(), x.find_complex_functions(3), x.find_undocumented(),
               x.find_security_issues("low"), x.find_env_usage(), x.find_async_code(), x.list_patterns(), x.find_by_pattern("traced"), x.list_repos(), x.get_repo_stats(), x.get_children("none")):
        assert df.count() >= 0
    mine = Explorer(x.spark, x.folder, repository="atlas-core", username="u_maelis")
    assert {r["repository"] for r in mine.elements.select("repository").distinct().collect()} <= {"atlas-core"}
