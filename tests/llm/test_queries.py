import pytest

from siftstone.llm.queries import QUERIES

#: Totals of counts, which have a row even where no data are.
ALWAYS = {"p6_agreement"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_and_dirty_tables(spark, edge_folders, name):
    empty, dirty = edge_folders
    got = QUERIES[name](spark, empty).count()
    assert got <= 1 if name in ALWAYS else got == 0
    QUERIES[name](spark, dirty).collect()


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found", "p6_found", "p7_found", "p9_found"])
def test_found_rows_are_distinct(spark, edge_folders, name):
    found = QUERIES[name](spark, edge_folders[1])
    assert found.count() == found.distinct().count()
