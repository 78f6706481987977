"""Chains of merges and the vector stage of entity resolution."""

from millrace.operators import resolution as R


def test_chains_are_followed_to_their_end(spark):
    hops = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (2, 3), (7, 7), (8, None), (None, 9), (20, 30), (20, 25), (50, 51), (51, 50), (52, 50)]
    got = {r.old: r.new for r in R.flatten_chains(spark.createDataFrame(hops, "old int, new int")).collect()}
    assert got == {i: 140 for i in range(100, 140)} | {1: 3, 2: 3, 20: 25, 50: 51, 51: 50, 52: 50}
    assert R.flatten_chains(spark.createDataFrame([], "old int, new int")).count() == 0


def test_vector_stage_after_names(spark):
    schema = "id string, name string, kind string, confidence double, vector array<double>"
    new = [("a", "Acme Corp", "org", 0.9, [1.0, 0.0]), ("b", "ACME corp", "org", 0.5, [0.0, 1.0]), ("c", "Zebra", "org", 0.5, [0.9, 0.1]), ("d", "Yak", "org", 0.5, [-1.0, 0.1]), ("e", "Quagga", "person", 0.5, [1.0, 0.0]), ("f", "Okapi", "org", 0.1, None)]
    old = [("x1", "Acme", "org", [1.0, 0.01]), ("x2", "Other", "org", [0.0, 1.0])]
    out = R.resolve_with_vectors(spark.createDataFrame(new, schema), spark.createDataFrame(old, "id string, name string, kind string, vector array<double>"))
    got = {r.old: (r.new, r.old_label, r.new_label, r.stage) for r in out.collect()}
    assert got == {"a": ("x1", "Acme Corp", "Acme", "vector"), "b": ("x1", "ACME corp", "Acme", "name"), "c": ("x1", "Zebra", "Acme", "vector")}
