"""Graph operators against brute force on random graphs."""

import random
from datetime import datetime

import pytest

from jobruns.operators import graph
from tests.conftest import values


def reach(edges):
    below = {}
    for a, b in edges:
        below.setdefault(a, set()).add(b)
    out = {}
    for start in {n for e in edges for n in e}:
        seen, todo = set(), list(below.get(start, ()))
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo.extend(below.get(n, ()))
        out[start] = seen
    return out


def make(spark, edges):
    return spark.createDataFrame(edges, "upstream_job_id long, downstream_job_id long")


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 25
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([15, 25, 40]))})
    df, expected = make(spark, edges), reach(edges)
    assert values(graph.closure(df)) == sorted(((a, d) for a, ds in expected.items() for d in ds), key=lambda r: tuple((True, str(v)) for v in r))
    on_cycle = {a for a, ds in expected.items() if a in ds}
    assert {r.job_id for r in graph.jobs_on_cycle(df).collect()} == on_cycle
    assert graph.has_cycle(df).first().has_cycle == bool(on_cycle)
    sources = spark.createDataFrame([(edges[0][0],), (edges[-1][0],)], "job_id long")
    got = [r.job_id for r in graph.descendants(df, sources).collect()]
    assert set(got) == expected[edges[0][0]] | expected[edges[-1][0]]
    assert len(got) == len(set(got))


def test_text_keys_two_cycles_joined_by_a_path(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "d"), ("z", "a"), ("s", "s")]
    df = spark.createDataFrame(edges, "upstream_job_id string, downstream_job_id string")
    assert {r.job_id for r in graph.jobs_on_cycle(df).collect()} == {"a", "b", "d", "e", "s"}


def test_a_cycle_does_not_run_forever(spark):
    df = make(spark, [(1, 2), (2, 1)])
    source = spark.createDataFrame([(1,)], "job_id long")
    assert {r.job_id for r in graph.descendants(df, source).collect()} == {1, 2}


def test_validate_edges(spark, table):
    edges = make(spark, [(1, 2), (2, 3), (4, 5)])
    proposed = table(
        "job_id long, side string, other_job_id long",
        (1, "upstream", 3),      # closes 1-2-3
        (5, "upstream", 5),      # itself
        (4, "upstream", 3),      # fine
        (7, "downstream", 8),    # fine
    )
    assert values(graph.validate_edges(edges, proposed)) == [(1, False), (4, True), (5, False), (7, True)]


def test_a_new_list_replaces_the_old_one(spark, table):
    edges = make(spark, [(1, 2), (3, 2), (2, 4)])
    proposed = table("job_id long, side string, other_job_id long", (2, "upstream", 9), (4, "upstream", None))
    assert values(graph.proposed_graph(edges, proposed)) == [(9, 2)]


def test_neighbourhood_drops_self_edges(spark, table):
    edges = make(spark, [(1, 2), (2, 2), (2, 3), (3, 4)])
    jobs = table("job_id long, name string", (1, "one"), (2, "two"))
    assert values(graph.neighbourhood_nodes(2, jobs, edges)) == [(1, "upstream", "one"), (2, "current", "two"), (3, "downstream", None)]
    assert values(graph.neighbourhood_edges(2, edges)) == [(1, 2), (2, 3)]


def test_diamond_gives_one_candidate(spark, table):
    edges = make(spark, [(1, 3), (2, 3), (5, 3), (1, 4)])
    jobs = table("job_id long, enabled boolean", (1, True), (2, True), (3, True), (4, False), (5, True))
    successes = table("job_id long", (1,), (2,))
    assert values(graph.candidates(successes, edges, jobs)) == [(3,)]
    assert values(graph.candidate_set(successes, edges, jobs)) == [(1,), (2,), (3,), (5,)]


def test_long_rings_and_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    ring = [(i, (i + 1) % 300) for i in range(300)]
    chain = [(20_000 + i, 20_001 + i) for i in range(300)]
    # Two jobs with three ways between them, each a chain, and one way back.
    ways = [(40_000, 41_000), (41_199, 40_001), (40_000, 42_000), (42_199, 40_001), (40_001, 43_000), (43_199, 40_000), (40_001, 44_000)]
    ways += [(b + i, b + i + 1) for b in (41_000, 42_000, 43_000, 44_000) for i in range(199)]
    df = make(spark, ring + chain + ways)
    on_cycle = {r.job_id for r in graph.jobs_on_cycle(df).collect()}
    assert on_cycle == {*range(300), 40_000, 40_001, *(b + i for b in (41_000, 42_000, 43_000) for i in range(200))}
    assert len(rounds) <= 40
    rounds.clear()
    assert graph.has_cycle(make(spark, chain)).first().has_cycle is False and len(rounds) <= 40


@pytest.mark.parametrize("local", [200_000, 0])
def test_no_chain_is_a_cycle(spark, monkeypatch, local):
    """Chains of every length, with components that one task holds and with rounds over all edges."""
    monkeypatch.setattr(graph, "LOCAL", local)
    lengths = range(1, 41)
    chains = [(1000 * n + i, 1000 * n + i + 1) for n in lengths for i in range(n)]
    assert graph.has_cycle(make(spark, chains)).first().has_cycle is False
    rings = [(100_000 * n + i, 100_000 * n + (i + 1) % n) for n in (1, 2, 3, 7, 16, 33) for i in range(n)]
    on_cycle = {r.job_id for r in graph.jobs_on_cycle(make(spark, chains + rings)).collect()}
    assert on_cycle == {a for a, _ in rings}


@pytest.mark.parametrize("local", [3, 12])
def test_large_components_go_through_rounds(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL", local)
    rng = random.Random(local)
    edges = sorted({(rng.randrange(25), rng.randrange(25)) for _ in range(22)} | {(100, 101), (101, 100), (200, 201)})
    df, expected = make(spark, edges), reach(edges)
    assert {r.job_id for r in graph.jobs_on_cycle(df).collect()} == {a for a, ds in expected.items() if a in ds}
    source = spark.createDataFrame([(edges[0][0],), (100,)], "job_id long")
    assert {r.job_id for r in graph.descendants(df, source).collect()} == expected[edges[0][0]] | {100, 101}


def test_a_deep_ladder_and_a_ring_take_few_rounds(spark, monkeypatch):
    rounds = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    monkeypatch.setattr(graph, "LOCAL", 31_000)  # less than both together, so components are looked for
    ring = [(i, (i + 1) % 10_000) for i in range(10_000)]
    ladder = [e for i in range(20_000, 30_000) for e in ((i, i + 1), (i + 50_000, i + 50_001), (i, i + 50_000))]
    df = make(spark, ring + ladder)
    assert graph.jobs_on_cycle(df).count() == 10_000 and len(rounds) <= 40
    rounds.clear()
    assert graph.descendants(df, spark.createDataFrame([(20_000,)], "job_id long")).count() == 20_001 and len(rounds) <= 40


def in_turn(edges, requests):
    """Requests taken one at a time: the verdicts and the edges left."""
    now, out = set(edges), []
    for (at, job), sides in sorted(requests.items()):
        after = set(now)
        if "upstream" in sides:
            after = {(a, b) for a, b in after if b != job} | {(a, job) for a in sides["upstream"]}
        if "downstream" in sides:
            after = {(a, b) for a, b in after if a != job} | {(job, b) for b in sides["downstream"]}
        accepted = job not in reach(after).get(job, ())
        now = after if accepted else now
        out.append((job, at, accepted))
    return sorted(out), sorted(now)


@pytest.mark.parametrize("seed, local", [(0, 200_000), (1, 200_000), (1, 6)])
def test_requests_one_after_another(spark, monkeypatch, seed, local):
    monkeypatch.setattr(graph, "LOCAL", local)
    rng, n = random.Random(seed), 10
    edges = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(14)) if a < b})
    requests = {}
    for _ in range(9):
        job, at = rng.randrange(n), datetime(2024, 1, 1, 0, rng.randrange(6))
        others = {x for x in (rng.randrange(n) for _ in range(rng.randrange(3))) if x != job}
        requests.setdefault((at, job), {})[rng.choice(["upstream", "downstream"])] = others
    rows = [(job, at, side, o) for (at, job), sides in requests.items() for side, others in sides.items() for o in (others or [None])]
    asked = spark.createDataFrame(rows, "job_id long, requested_at timestamp_ntz, side string, other_job_id long")
    df = make(spark, edges)
    verdict = graph.cut_lineage(graph.accept_edges(df, asked))
    accepted, left = in_turn(edges, requests)
    assert sorted(map(tuple, verdict.collect())) == accepted
    assert sorted(map(tuple, graph.edges_after(df, asked, verdict).collect())) == left


def test_of_two_that_close_a_circle_the_first_stays(spark, table):
    asked = table("job_id long, requested_at time, side string, other_job_id long", (1, "2024-01-01 00:00:02", "upstream", 2), (2, "2024-01-01 00:00:01", "upstream", 1))
    assert values(graph.accept_edges(make(spark, [(8, 9)]), asked), "job_id", "accepted") == [(1, False), (2, True)]


def test_descendants_of_each(spark):
    df = make(spark, [(1, 2), (2, 3), (3, 2), (4, 1)])
    sources = spark.createDataFrame([(1,), (3,), (9,)], "job_id long")
    assert values(graph.descendants_of_each(df, sources)) == [(1, 2), (1, 3), (3, 2), (3, 3)]


def test_descendants_along_a_chain_of_many_tasks_take_few_rounds(spark, monkeypatch):
    rounds = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    monkeypatch.setattr(graph, "LOCAL", 20)
    # A chain with two sources in it, a fork behind it, a ring that is reached and one that is not.
    edges = [(i, i + 1) for i in range(200)] + [(200, 301), (301, 302), (302, 303), (303, 301), (200, 401), (501, 502), (502, 501)]
    found = [r.job_id for r in graph.descendants(make(spark, edges), spark.createDataFrame([(50,), (120,), (401,)], "job_id long")).collect()]
    assert sorted(found) == [*range(51, 201), 301, 302, 303, 401] and len(rounds) <= 40


def test_rounds_send_nothing_through_the_driver_and_estimates_stay_small(spark, monkeypatch):
    seen = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: seen.append(df) or cut(df))
    components = graph.weak_components(make(spark, [(i, i + 1) for i in range(0, 60, 2)] + [(i + 1, i) for i in range(1, 60, 2)]))
    assert values(components, "component") == [(0,)] * 61
    plans = [df._jdf.queryExecution() for df in seen]
    assert all("BroadcastHashJoin" not in p.executedPlan().toString() for p in plans)
    assert int(str(components._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 2**40
