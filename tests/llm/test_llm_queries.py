"""Queries of the subpackage on the smallest tables."""

import pytest

from ferrule.llm.queries import registries
from tests.oracle import compare, connect

QUERIES = {n: q for r in registries() for n, q in r.queries.items()}
SQL = {n: s for r in registries() for n, s in r.sql.items()}


#: A hundred texts expose no limit; limits are tested in test_text_operators.py.
TOO_FEW_ROWS = {"p10_limits"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small):
    if name in SQL:
        assert compare(name, QUERIES[name], SQL[name], spark, small, connect(small)) is None
    else:
        n = QUERIES[name](spark, small).count()
        assert n > 0 or name in TOO_FEW_ROWS


def test_containers_hold_every_document_whole(spark, small):
    """No text is lost or cut below the capacity, no container is overfull, and few are needed."""
    from ferrule.llm import packing

    rows = QUERIES["p8_containers"](spark, small).toPandas()
    want = packing.token_counts(spark.read.parquet(f"{small}/documents.parquet")).toPandas().set_index("doc_id")["n_tokens"]
    assert (rows.groupby("doc_id")["n_tokens"].sum().sort_index() == want.sort_index()).all()
    used = rows.dropna(subset=["container"]).groupby("container")["n_tokens"].sum()
    parts = rows.groupby("doc_id").size()
    assert used.max() <= packing.CAPACITY and (parts[want[want <= packing.CAPACITY].index] == 1).all() and len(used) <= 1.1 * -(-want.sum() // packing.CAPACITY) + 1


def test_pieces_join_to_every_text(spark, small):
    from ferrule.llm import split

    rows = QUERIES["p1_pieces"](spark, small).toPandas().sort_values(["element_id", "piece_no"])
    assert rows["piece"].str.len().max() <= split.LIMIT
    texts = {r["element_id"]: r["raw_code"] for r in spark.read.parquet(f"{small}/code_elements.parquet").select("element_id", "raw_code", "row_id", "indexed_at").orderBy("indexed_at", "row_id").collect()}
    whole = rows.groupby("element_id")["piece"].apply(lambda p: split.joined(list(p)))
    assert all(texts[e] == t for e, t in whole.items()) and len(whole) == sum(t is not None for t in texts.values())


def test_every_file_is_judged(spark, tmp_path):
    """Also TOML, which p5_found never reports, and the newest version only."""
    texts = [("a.toml", "toml", "x = 1\n"), ("b.toml", "toml", "x = [1\n"), ("c.py", "python", "f(\n"), ("d", None, "(("), ("e.toml", "toml", None), ("f.css", "css", "{")]
    rows = [(i, f"s:r:main:{p}:file:{p}:0", 1, "file", "r", "main", p, g, t) for i, (p, g, t) in enumerate(texts)]
    rows += [(9, rows[0][1], 0, "file", "r", "main", "a.toml", "toml", "x = [1\n")]
    spark.createDataFrame(rows, "row_id long, element_id string, indexed_at int, element_type string, repository string, username string, relative_path string, language string, raw_code string").write.parquet(f"{tmp_path}/code_elements.parquet")
    said = [("r", "main", "b.toml", ["No parser for language: toml"]), ("r", "main", "c.py", ["unexpected EOF"])]
    spark.createDataFrame(said, "repository string, username string, relative_path string, parse_errors array<string>").write.parquet(f"{tmp_path}/parsed_files.parquet")
    rates = {(r.key_field, r.key_value): (r.n_files, r.n_invalid, r.n_reported) for r in QUERIES["p5_rates"](spark, str(tmp_path)).collect()}
    assert rates == {("repository", "r"): (6, 2, 1), ("language", "toml"): (3, 1, 0), ("language", "python"): (1, 1, 1), ("language", None): (1, 0, 0), ("language", "css"): (1, 0, 0)}
    assert [r.relative_path for r in QUERIES["p5_found"](spark, str(tmp_path)).collect()] == ["c.py"]
