from rowdelta.llm.graph import components


def test_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(500, 500), (7, 3), (3, 7), (-4, 900)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50))
    assert got[500] == 500 and got[900] == -4


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
