"""Graph matches in cells of users by nodes against plain Python."""
from newsgraph.operators import curate


def test_matches_in_cells(spark, monkeypatch):
    """Many cells give the rows of one, reasons are distinct and in order, and attributes come with the nodes."""
    follows = [(u, f"{n} ", 1.0) for u in range(12) for n in ("B", "a", "A", "ä", "c", "z") if (u + ord(n)) % 3] + [(None, "a", 1.0), (3, None, 1.0)]
    links = [("a", "n1"), ("b", "n1"), ("n1", "n2"), ("n2", "n3"), ("n3", "n4"), ("ä", "n3"), ("c", "c"), ("c", "a"), ("z", None)]
    ui = spark.createDataFrame(follows, "user_id long, name string, weight double")
    edges = spark.createDataFrame(links, "src string, dst string")
    about = spark.createDataFrame([("n1", 5), ("n3", 7), ("a", 1)], "node string, n long")
    want = {}
    for user, name, _ in follows:
        near = {} if name is None else {name.strip().lower(): 0}
        for d in (1, 2, 3):
            for s, t in links:
                if near.get(s) == d - 1:
                    near.setdefault(t, d)
        for node, d in near.items():
            best, why = want.setdefault((user, node), [d, set()])
            want[user, node][0] = min(best, d)
            why.add(f"Follows {name}")
    n = dict(about.collect())
    expected = {(u, x, d, tuple(sorted(w)), n.get(x)) for (u, x), (d, w) in want.items()}
    for size in (1_000_000, 4):
        monkeypatch.setattr(curate, "CELL_PAIRS", size)
        rows = curate.matched_nodes(ui, edges, 3, about).collect()
        got = {(r.user_id, r.node, r.graph_depth, tuple(r.match_reasons), r.n) for r in rows}
        assert got == expected and len(rows) == len(expected)
    assert curate.matched_nodes(ui.limit(0), edges, 3).count() == 0


def test_cells():
    assert curate._blocks(0, 0, 0) == (1, 1)
    users, nodes = curate._blocks(2_600_000_000, 4_400_000, 59_000)
    assert users * nodes >= 2600 and nodes > 1
