import json

import duckdb

from newsloom.llm import queries


def test_the_twin_leaves_out_what_is_no_finite_vector():
    """Five kinds of unusable lists, one of them with NaN, and three usable vectors: only these pair."""
    good = [1.0] + [0.0] * 383
    near = [1.0, 0.1] + [0.0] * 382
    texts = {1: json.dumps(good), 2: json.dumps(near), 3: json.dumps([-v for v in good]), 4: "[NaN" + ",0.5" * 383 + "]", 5: json.dumps([0.0] * 384), 6: "[1,2]", 7: None, 8: "[1e999" + ",0.5" * 383 + "]"}
    con = duckdb.connect()
    con.execute("CREATE TABLE article_embeddings (raw_article_id BIGINT, vector_json VARCHAR, model_name VARCHAR)")
    con.executemany("INSERT INTO article_embeddings VALUES (?, ?, 'local/hash-minilm-384')", list(texts.items()))
    assert con.execute(queries.ORACLES["p7_found"]).fetchall() == [(1, 2)]
