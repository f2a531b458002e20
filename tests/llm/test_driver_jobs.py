import numpy as np

from lintlake.llm import components, jaccard


def jobs_of(spark, run):
    """What ``run`` returns, and the Spark jobs that it took."""
    context = spark.sparkContext
    group = f"jobs-{np.random.default_rng().integers(1 << 60)}"
    context.setJobGroup(group, group)
    try:
        return run(), len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "a long, b long")


def test_a_small_graph_takes_few_jobs(spark):
    """Jobs on a few edges cost the driver as much memory as jobs on many."""
    chain = edges_of(spark, [(i * 7 % 61, (i + 1) * 7 % 61) for i in range(60)])
    got, jobs = jobs_of(spark, lambda: components.connected_components(chain).collect())
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(61)]
    assert jobs <= 8


def test_a_join_takes_few_jobs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got, jobs = jobs_of(spark, lambda: jaccard.jaccard_components(docs).collect())
    assert len(got) == docs.count()
    assert jobs <= 90


def test_rounds_and_the_last_task_give_the_same(spark, monkeypatch):
    """With more edges than a task takes there are rounds until few are left, or none."""
    rng = np.random.default_rng(8)
    rows = [(int(a), int(b)) for a, b in rng.integers(-60, 160, (120, 2))] + [(500, 500), (900 - 1, 900), (900, 900 - 1)]
    rows += [(int(a), 1000) for a in range(1001, 1030)]
    want = sorted(map(tuple, components.connected_components(edges_of(spark, rows)).collect()))
    assert (899, 899) in want and (900, 899) in want and (1029, 1000) in want and 500 not in dict(want)
    for most in (0, 3, 40, 100):
        monkeypatch.setattr(components, "TASK_EDGES", max(most, 1))
        assert sorted(map(tuple, components.connected_components(edges_of(spark, rows)).collect())) == want
