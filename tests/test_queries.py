"""Every registered query of the engine against its SQL in DuckDB; those without SQL for their rows only."""

import os

import pytest
from duck import assert_equal

from lacuna.oracle import SQL
from lacuna.queries import QUERIES

SF = os.environ.get("LACUNA_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert_equal(spark, SF, QUERIES[name], SQL[name])


def test_every_query_has_sql_or_is_known_to_lack_it():
    assert set(QUERIES) - set(SQL) == {"evaluation_rows", "evaluation_json", "w2v_neighbours"}


def test_w2v_trains_the_full_model(spark, monkeypatch):
    from lacuna import queries

    seen = []

    def train(corpus, **settings):
        seen.append(settings)
        return real(corpus.limit(50), **settings)

    real = queries.vectors.train
    monkeypatch.setattr(queries.vectors, "train", train)
    assert QUERIES["w2v_neighbours"](spark, SF).columns == ["query", "rank", "word", "score"]
    assert not {"size", "rounds"} & set(seen[0])
