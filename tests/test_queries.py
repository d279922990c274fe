"""Registered graph queries return whole results."""

import inspect
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ringscope.graph import Graph
from ringscope.operators import detect
from ringscope.plans import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["km_er_move_gain", "km_config_move_gain"])
def test_move_gains_cover_every_node(spark, name):
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    whole = oracle.oracle_sql()[name]
    keyed = lambda rows: {tuple(r[:5]): float(r[5]) for r in rows}
    expected, found = keyed(db.execute(whole).fetchall()), keyed(queries.queries()[name](spark, SF).collect())
    assert len({k[0] for k in found}) == queries.user(spark, SF).nodes.count()
    assert found == pytest.approx(expected, abs=2e-6)


def test_label_rounds_go_on_when_the_coin_moves_none(spark):
    g = Graph.from_edges(spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, w double")).settled()
    first = g.nodes.agg(*[F.min(detect.uniform(s, F.lit(0), "g", "node")) for s in range(64)]).first()
    seed = next(s for s in range(64) if first[s] >= 0.5)
    assert len({r.c for r in detect.label_rounds(g, "km_config", seed).collect()}) == 1


def test_label_rounds_report_their_bound(spark):
    g = Graph.from_edges(spark.createDataFrame([(i, i + 1, 1.0) for i in range(8)], "src long, dst long, w double")).settled()
    with pytest.warns(RuntimeWarning, match="can still gain after 1 rounds"):
        detect.label_rounds(g, "km_config", rounds=1)


def test_moves_apart_share_no_group(spark):
    rows = [(0, 1, 1, (2, 1), 0.5), (0, 2, 2, (1, 1), 0.9), (0, 3, 3, (3, 0), 0.1), (0, 4, 4, (3, 1), 0.05), (0, 5, 5, (6, 1), 0.2)]
    wants = spark.createDataFrame(rows, "g int, node long, c long, to struct<to_c:long,to_x:int>, rise double")
    assert {r.node for r in detect._apart(wants).collect()} == {2, 3, 5}


def test_detectors_are_registered_with_full_parameters():
    found = {k: inspect.getclosurevars(q).nonlocals.get("parameters") for k, q in queries.queries().items() if k.endswith("_detect")}
    assert {k for k, v in found.items() if v} == set() and len(found) == 13
    default = lambda f, name: inspect.signature(f).parameters[name].default
    assert default(detect.minres, "steps") >= 10_000 and default(detect.lanczos, "restarts") >= 100


def test_rank_two_degrees_are_exact_beside_a_hub(spark):
    a, b = np.random.default_rng(2).normal(size=(2, 80))
    a[0], b[1] = 200.0, -300.0
    points = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "g int, node long, a double, b double")
    found = {r.node: r.v for r in detect.entries_above(points, 1.5, -0.7).collect()}
    assert found == dict(enumerate((1.5 * np.outer(a, a) - 0.7 * np.outer(b, b) > 0.5).sum(1)))


def test_random_labels_are_not_valid(spark):
    """Each bound of the _valid queries turns red for random labels."""
    user, page, nation = (make(spark, SF).settled() for make in (queries.user, queries.page, queries.nation))
    random = lambda g, x: queries.one_pair(g.nodes.withColumn("x", x))
    coin, number = (detect.uniform(9, "node") < 0.5).cast("int"), detect.uniform(9, "node")
    at_least, scores = queries.at_least, queries.scores
    for g, good, x in (
        (page, at_least(scores.be, queries.lip_labels), coin), (page, at_least(scores.km_er, queries.lip_labels), coin), (page, at_least(scores.modularity, queries.components_as_groups), coin),
        (user, at_least(queries.true_cut, queries.degree_cut, 0.9), coin), (user, at_least(queries.true_cut, queries.degree_cut, 0.65), coin),
        (user, queries.persistence_profile, number), (user, queries.nearer_than_chance, number), (user, queries.no_swap_left, number), (nation, queries.no_swap_left, number),
    ):
        assert not good(g, random(g, x)).first()[0], good
