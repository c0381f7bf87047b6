"""The operators that SQL can express, against it, at the smallest scale; and the registry's shape."""

import pytest

from snaptide.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(name, agree):
    agree(registry.queries()[name], registry.oracle_sql()[name])


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


def test_the_pipeline_is_registered():
    import __spark_entry__ as e
    import corpus_pipeline

    assert "pipeline" in e.queries() and len(corpus_pipeline.STAGES) == 5
