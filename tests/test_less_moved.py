import random

from pyspark.sql import functions as F

from ropeway.operators import graph as G
from ropeway.operators import rules as R
from ropeway.session import ROWS_PER_TASK


def test_arbitration_copies_no_rows_to_bands_unless_a_cell_is_busy(spark, tiny_tasks):
    rng = random.Random(2)
    rows = [(i, rng.randrange(6), rng.randrange(2), rng.choice([0.1, 0.12, 0.2, 0.5, 0.9]), rng.randrange(3), rng.randrange(25), f"n{i}") for i in range(150)]
    p = spark.createDataFrame(rows, "id long, cell_id long, safety int, confidence double, ts long, w long, note string")
    reach = spark.createDataFrame([(a, b) for a in range(6) for b in range(6) if abs(a - b) <= 1], "cell_id long, near long")
    banded = R.arbitration(p, reach, "w", "cell_id")
    assert "explode" in banded._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(tuple, banded.collect()))
    spark.conf.unset(ROWS_PER_TASK)
    whole = R.arbitration(p, reach, "w", "cell_id")
    assert "explode" not in whole._jdf.queryExecution().optimizedPlan().toString()
    assert whole.columns == banded.columns and sorted(map(tuple, whole.collect())) == want
    assert len(want) == 150 and len({r[-1] for r in want}) >= 3


def test_topology_components_see_links_between_targets_only(spark, monkeypatch):
    seen, real = [], G.components

    def counted(edges, *a, **k):
        seen.append(edges.count())
        return real(edges, *a, **k)

    monkeypatch.setattr(G, "components", counted)
    # 40 sources over two targets, a chain through a source that is a target too, a loop, a second snapshot
    rows = [(1, i, 100 + i % 2) for i in range(40)] + [(1, 200, 201), (1, 201, 202), (1, 300, 300), (2, 1, 100), (2, 1, 101), (2, 2, 101), (2, 3, 102)]
    got = G.topology_signature(spark.createDataFrame(rows, "d int, a int, b int"), "d", "a", "b", F.col("id")).collect()
    assert {r.d: (r.edges, r.components) for r in got} == {1: (43, 4), 2: (4, 2)}
    assert seen[0] <= 10


def test_blast_sizes_read_cells_and_links_once(spark, tiny_tasks):
    ran = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        ran.add(1)
        return x

    once = counted.asNondeterministic()
    spark.conf.set("ropeway.broadcastRows", "3")
    try:
        cells = spark.range(24).select(once("id").alias("cell"), F.floor(F.col("id") / 6).alias("site"))
        edges = spark.range(20).select(once("id").alias("source"), (F.col("id") + 3).alias("target"))
        got = {r.cell: r.blast for r in G.blast_sizes(edges, cells, "cell", "site").collect()}
    finally:
        spark.conf.unset("ropeway.broadcastRows")
    # five beside it, and the link ends at another site for the last three cells of a site
    assert got == {c: 5 + (c < 20 and c % 6 >= 3) for c in range(24)}
    assert ran.value == 24 + 20
