from constellate.operators import graph as G


def test_fill_writes_few_pairs_of_a_round_and_keeps_one_rest(spark, monkeypatch):
    n = 40
    rows = [(a, b, ((a * 7 + b * 13) % 101) / 101) for a in range(n) for b in range(a + 1, n)]
    df = spark.createDataFrame(rows, "i int, j int, similarity double")
    protected = spark.createDataFrame([(0, b) for b in range(1, 6)], "i int, j int")
    bounds = spark.createDataFrame([(v, 4) for v in range(n)], "member int, bound bigint")
    released = []
    real = G.release
    monkeypatch.setattr(G, "release", lambda x: released.append(1) or real(x), raising=True)
    got = {(r.i, r.j) for r in G.fill_within_bounds(df, protected, bounds).collect()}
    degree, want = {v: 0 for v in range(n)}, {(0, b) for b in range(1, 6)}
    for a, b in want:
        degree[a] += 1
        degree[b] += 1
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if (a, b) not in want and degree[a] < 4 and degree[b] < 4:
            want.add((a, b))
            degree[a] += 1
            degree[b] += 1
    assert got == want and released
