from lintlake.sources.store import written_once


def test_a_relation_is_made_once_a_session_and_source(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert [written_once(spark, "numbers", source, make).count() for source in ("x", "x", "y")] == [3, 3, 3]
    assert len(made) == 2
