from graphloom.operators import covering
from graphloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def test_independent_set_local_answers_every_vertex(spark):
    g = catalogue.parts(spark, FOLDER)
    got = {r.id: r.status for r in catalogue.independent_set_local(spark, FOLDER).collect()}
    chosen = {r.id for r in covering.independent_set(g, "hash").collect()}
    assert got == {r.id: "in" if r.id in chosen else "out" for r in g.vertices.select("id").collect()}


def test_densest_greedy_plus_reaches_what_twenty_peelings_reach(spark):
    """Repeated greedy peeling of this graph, 20 times, ends at 2.106952."""
    assert catalogue.densest_greedy_plus(spark, "/root/testdata/sf0.01").first().density >= 2.1069
