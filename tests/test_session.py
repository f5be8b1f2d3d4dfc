import pytest

from genoframe.session import cut, drop_cut


def test_only_a_cut_itself_is_dropped(spark):
    made = cut(spark.range(5))
    derived = made.select("id")
    drop_cut(derived)
    assert made.count() == 5
    drop_cut(made)
    drop_cut(spark.range(3))


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scratch_keeps_what_is_taken_out(spark):
    from genoframe.session import cut, scratch

    with scratch() as made:
        first = cut(spark.range(3))
        last = cut(first.where("id > 0"))
        made.pop()
    assert last.count() == 2
    with pytest.raises(Exception, match="(?i)does not exist|not found|path"):
        first.count()
