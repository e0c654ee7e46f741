"""Reachability and cycles of the dependency graph.

Spark's recursive queries only know UNION ALL, which does not end on a cycle, so the loops are
written here: each round works on what the round before found new, and its result is written to
the checkpoint folder, which keeps plans short and lets a lost executor be replaced.

Most questions are answered within a weakly connected component: workflows are many and small. Components are found
in a logarithmic number of rounds and dealt to tasks, which walk theirs to the end, however deep. Before that, chains are drawn
together, so that one through the whole table is an edge. A component of more than ``LOCAL`` edges that is left is not given to
one task; its jobs go through rounds over all of its edges.

Rounds join by merging: a broadcast in each of them would send its rows through the driver every time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Hashable, Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobruns.session import cut_lineage

UP, DOWN = "upstream_job_id", "downstream_job_id"

# A result that grows by one piece per round is written out as one after this many.
_PIECES = 8

#: Edges that one task may hold; a graph of no more needs no components.
LOCAL = 200_000


def _grown(found: DataFrame, piece: DataFrame, rounds: int) -> DataFrame:
    found = found.unionByName(piece)
    return cut_lineage(found) if rounds % _PIECES == 0 else found


def _merged(df: DataFrame) -> DataFrame:
    """``df`` for the right side of a join that must not send it through the driver."""
    return df.hint("merge")


def weak_components(edges: DataFrame) -> DataFrame:
    """``(job_id, component)``: jobs that hang together, whatever the direction, by the smallest of them.

    Every job points to a smaller one of its component. In a round the job that a job points to takes the smallest job that
    is pointed to twice removed by a neighbour, and every job skips one step, so paths shrink to a half at least."""
    both = F.inline(F.array(F.struct(F.col(UP).alias("job_id"), F.col(DOWN).alias("other")), F.struct(F.col(DOWN).alias("job_id"), F.col(UP).alias("other"))))
    near = cut_lineage(edges.select(both).distinct())
    at = near.groupBy("job_id").agg(F.least(F.min("other"), F.col("job_id")).alias("root"))
    at = cut_lineage(at)
    while True:
        skip = at.join(_merged(at.select(F.col("job_id").alias("root"), F.col("root").alias("second"))), "root")
        least = near.join(_merged(skip.select(F.col("job_id").alias("other"), F.col("second").alias("offer"))), "other").groupBy("job_id").agg(F.min("offer").alias("offer"))
        offers = skip.join(_merged(least), "job_id").select(
            F.inline(
                F.array(
                    F.struct(F.col("job_id").alias("job_id"), F.least("second", "offer").alias("offer")),
                    F.struct(F.col("root").alias("job_id"), F.col("offer").alias("offer")),
                )
            )
        )
        best = offers.groupBy("job_id").agg(F.min("offer").alias("offer"))
        after = cut_lineage(
            at.join(_merged(best), "job_id").select("job_id", F.least("root", "offer").alias("root"), (F.col("offer") < F.col("root")).alias("moved"))
        )
        at = after.select("job_id", "root")
        if after.where("moved").isEmpty():
            return at.withColumnRenamed("root", "component")


class Chains(NamedTuple):
    """A graph with its chains drawn together. A chain's jobs have one edge in and one out; ``inner`` has them (``job_id, head``) with
    the first job of their chain, ``ends`` the jobs before and after each chain (``head, start, end``), and ``edges`` leads from one
    to the other. ``rings`` are the jobs of cycles that nothing else touches, with the least of each (``job_id, label``)."""

    edges: DataFrame
    inner: DataFrame
    ends: DataFrame
    rings: DataFrame


def contracted(edges: DataFrame, keep: DataFrame | None = None) -> Chains:
    """Draw chains together; jobs in ``keep`` stay as they are. Each round doubles how far a job sees back along its chain, so the
    rounds are the logarithm of the longest one."""
    edges = cut_lineage(edges.select(UP, DOWN).distinct())
    ends = F.inline(
        F.array(
            F.struct(F.col(UP).alias("job_id"), F.col(DOWN).alias("end"), F.lit(None).alias("start")),
            F.struct(F.col(DOWN).alias("job_id"), F.lit(None).alias("end"), F.col(UP).alias("start")),
        )
    )
    single = (
        edges.select(ends)
        .groupBy("job_id")
        .agg(F.min("start").alias("start"), F.min("end").alias("end"), F.count("start").alias("ins"), F.count("end").alias("outs"))
        .where((F.col("ins") == 1) & (F.col("outs") == 1) & (F.col("start") != F.col("job_id")))
        .select("job_id", "start", "end")
    )
    single = cut_lineage(single if keep is None else single.join(_merged(keep.select("job_id")), "job_id", "left_anti"))
    before = single.select(F.col("job_id").alias("start"), F.lit(True).alias("_before"))
    after = single.select(F.col("job_id").alias("end"), F.lit(True).alias("_after"))
    flagged = cut_lineage(
        single.join(_merged(before), "start", "left").join(_merged(after), "end", "left")
        .select("job_id", "start", "end", F.col("_before").isNull().alias("first"), F.col("_after").isNull().alias("last"))
    )
    at = flagged.select("job_id", F.when(F.col("first"), F.col("job_id")).otherwise(F.col("start")).alias("head"), F.col("first").alias("done"), F.col("job_id").alias("label"))
    # After r rounds a job knows what is 2^r steps back, so the longest chain takes as many rounds as its length has bits.
    for _ in range(flagged.count().bit_length() + 1):
        if at.where("NOT done").isEmpty():
            break
        further = at.select(F.col("job_id").alias("head"), F.col("head").alias("_head"), F.col("done").alias("_done"), F.col("label").alias("_label"))
        on = at.where("NOT done").join(_merged(further), "head").select("job_id", F.col("_head").alias("head"), F.col("_done").alias("done"), F.least("label", "_label").alias("label"))
        at = cut_lineage(at.where("done").unionByName(on))
    # What finds no first job after that many doublings goes round.
    rings = at.where("NOT done").select("job_id", "label")
    inner = at.where("done").select("job_id", "head")
    limits = flagged.where("first OR last").join(_merged(inner), "job_id")
    ends = cut_lineage(
        limits.groupBy("head").agg(F.max(F.when(F.col("first"), F.col("start"))).alias("start"), F.max(F.when(F.col("last"), F.col("end"))).alias("end"))
    )
    kept = edges.join(_merged(single.select(F.col("job_id").alias(UP))), UP, "left_anti").join(
        _merged(single.select(F.col("job_id").alias(DOWN))), DOWN, "left_anti"
    )
    drawn = ends.select(F.col("start").alias(UP), F.col("end").alias(DOWN))
    return Chains(cut_lineage(kept.select(UP, DOWN).unionByName(drawn).distinct()), inner, ends, rings)


class Dealt(NamedTuple):
    """Edges by ``block``, whole components each, that a task can hold; those of larger components; and, unless one block holds all
    edges as they are, the chains that were drawn together."""

    blocks: DataFrame
    large: DataFrame
    chains: Chains | None


def dealt(edges: DataFrame, keep: DataFrame | None = None) -> Dealt:
    """Jobs in ``keep`` (column ``job_id``) are in no chain."""
    # Written with its block: a constant would make joins by block products.
    edges = cut_lineage(edges.select(UP, DOWN, F.lit(0).alias("block")).distinct())
    if edges.count() <= LOCAL:
        return Dealt(edges, edges.select(UP, DOWN).limit(0), None)
    chains = contracted(edges.select(UP, DOWN), keep)
    edges = chains.edges
    total = edges.count()
    if total <= LOCAL:
        return Dealt(cut_lineage(edges.withColumn("block", F.lit(0))), edges.limit(0), chains)
    named = cut_lineage(edges.join(_merged(weak_components(edges).withColumnRenamed("job_id", UP)), UP))
    sizes = named.groupBy("component").agg(F.count("*").alias("n"))
    large = cut_lineage(sizes.where(F.col("n") > LOCAL).select("component"))
    # As many blocks as hold half of what a task can hold, so that uneven ones fit as well.
    block = F.pmod(F.xxhash64("component"), F.lit(total // (LOCAL // 2 + 1) + 1)).cast("int")
    small = named.join(large, "component", "left_anti").select(UP, DOWN, block.alias("block"))
    return Dealt(small, cut_lineage(named.join(large, "component", "left_semi").select(UP, DOWN)), chains)


def _reached(edges: pd.DataFrame) -> pd.DataFrame:
    """What lies below the edges' marked upstream jobs."""
    below, todo = defaultdict(list), []
    for up, down, start in zip(edges[UP], edges[DOWN], edges["start"], strict=True):
        below[up].append(down)
        if start:
            todo.append(down)
    seen = set()
    while todo:
        job = todo.pop()
        if job not in seen:
            seen.add(job)
            todo.extend(below[job])
    return pd.DataFrame({"job_id": pd.Series(list(seen), dtype=edges[DOWN].dtype)})


def descendants(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Every job reachable downstream of the source jobs (column ``job_id``), at any depth. A source
    is part of the result only when it lies on a cycle or below another source."""
    wanted = cut_lineage(sources.select("job_id").distinct())
    parts = dealt(edges, wanted)
    marks = wanted.select(F.col("job_id").alias(UP), F.lit(True).alias("start"))
    marked = parts.blocks.join(_merged(marks), UP, "left").select("block", UP, DOWN, F.coalesce("start", F.lit(False)).alias("start"))
    touched = marked.where("start").select("block").distinct()
    kind = edges.schema[DOWN].dataType.simpleString()
    found = marked.join(touched, "block", "left_semi").groupBy("block").applyInPandas(lambda rows: _reached(rows), f"job_id {kind}")
    if not parts.large.isEmpty():
        found = found.unionByName(_descendants_by_level(parts.large, wanted))
    # A chain is below the job before it; no source lies in one.
    found = cut_lineage(found)
    if parts.chains is None:
        return found
    above = found.unionByName(wanted).distinct().withColumnRenamed("job_id", "start")
    passed = parts.chains.ends.join(_merged(above), "start", "left_semi").select("head")
    return found.unionByName(parts.chains.inner.join(passed, "head", "left_semi").select("job_id"))


def _descendants_by_level(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The same in a round per level."""
    edges = edges.select(UP, DOWN)
    frontier = cut_lineage(sources)
    found, rounds = frontier.limit(0), 0
    while True:
        step = (
            edges.join(_merged(frontier.select(F.col("job_id").alias(UP))), UP, "left_semi")
            .select(F.col(DOWN).alias("job_id"))
            .distinct()
            .join(_merged(found), "job_id", "left_anti")
        )
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            return found
        rounds += 1
        found = _grown(found, frontier, rounds)


def descendants_of_each(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source, descendant)`` for the source jobs (column ``job_id``) only."""
    edges = cut_lineage(edges.select(UP, DOWN).distinct())
    frontier = cut_lineage(sources.select(F.col("job_id").alias("source"), F.col("job_id").alias("descendant")).distinct())
    found, rounds = frontier.limit(0), 0
    while True:
        step = (
            frontier.withColumnRenamed("descendant", UP)
            .join(edges, UP)
            .select("source", F.col(DOWN).alias("descendant"))
            .distinct()
            .join(found, ["source", "descendant"], "left_anti")
        )
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            return found
        rounds += 1
        found = _grown(found, frontier, rounds)


def closure(edges: DataFrame) -> DataFrame:
    """All pairs ``(ancestor, descendant)``. Its size is what the question asks for: it grows with
    the square of a component. Use :func:`descendants`, :func:`descendants_of_each` or
    :func:`jobs_on_cycle` where they do.

    Pairs carry their distance. When all pairs up to distance ``n`` are known, those at exactly
    ``n`` followed by any known pair give all up to ``2n``, so the number of rounds is the logarithm
    of the depth.
    """
    found = cut_lineage(
        edges.select(F.col(UP).alias("ancestor"), F.col(DOWN).alias("descendant"), F.lit(1).alias("distance"))
        .distinct()
    )
    known, rounds = 1, 0
    while True:
        prefix = found.where(F.col("distance") == known).select("ancestor", F.col("descendant").alias("middle"))
        suffix = found.select(F.col("ancestor").alias("middle"), "descendant", "distance")
        longer = (
            prefix.join(suffix, "middle")
            .groupBy("ancestor", "descendant")
            .agg((F.min("distance") + known).alias("distance"))
            .join(found, ["ancestor", "descendant"], "left_anti")
        )
        piece = cut_lineage(longer)
        if piece.isEmpty():
            return found.select("ancestor", "descendant")
        known, rounds = known * 2, rounds + 1
        found = _grown(found, piece, rounds)


def _peel_once(edges: DataFrame) -> DataFrame:
    """Drop edges that leave a job nothing leads to, and edges into a job nothing leaves."""
    fed = edges.select(F.col(DOWN).alias(UP)).distinct()
    feeding = edges.select(F.col(UP).alias(DOWN)).distinct()
    return edges.join(_merged(fed), UP, "left_semi").join(_merged(feeding), DOWN, "left_semi").select(UP, DOWN)


def cyclic_core(edges: DataFrame) -> DataFrame:
    """What is left after peeling: empty exactly when the graph has no cycle."""
    core = cut_lineage(edges.select(UP, DOWN).distinct())
    size = core.count()
    while size:
        core = cut_lineage(_peel_once(_peel_once(core)))
        remaining = core.count()
        if remaining == size:
            break
        size = remaining
    return core


def _strong(edges: pd.DataFrame) -> pd.DataFrame:
    """``(job_id, label)`` of the jobs on cycles; a label is one job of the strongly connected component. Depth first,
    with the path kept in a list (Tarjan)."""
    below: dict[Hashable, list] = defaultdict(list)
    loops = set()
    for up, down in zip(edges[UP], edges[DOWN], strict=True):
        below[up].append(down)
        if up == down:
            loops.add(up)
    order: dict[Hashable, int] = {}
    low: dict[Hashable, int] = {}
    held, open_jobs, found = [], set(), []
    for start in list(below):
        if start in order:
            continue
        path = [(start, iter(below[start]))]
        order[start] = low[start] = len(order)
        held.append(start)
        open_jobs.add(start)
        while path:
            job, rest = path[-1]
            nxt = next((d for d in rest if d not in order or d in open_jobs), None)
            if nxt is None:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[job])
                if low[job] == order[job]:
                    members = [held.pop()]
                    while members[-1] != job:
                        members.append(held.pop())
                    open_jobs.difference_update(members)
                    if len(members) > 1 or job in loops:
                        found += [(m, job) for m in members]
            elif nxt in order:
                low[job] = min(low[job], order[nxt])
            else:
                order[nxt] = low[nxt] = len(order)
                held.append(nxt)
                open_jobs.add(nxt)
                path.append((nxt, iter(below[nxt] if nxt in below else ())))
    kind = edges[UP].dtype
    return pd.DataFrame({"job_id": pd.Series([m for m, _ in found], dtype=kind), "label": pd.Series([x for _, x in found], dtype=kind)})


def cyclic_components(edges: DataFrame) -> DataFrame:
    """``(job_id, label)`` of the jobs that are their own descendants, by strongly connected component: jobs of the graph with its chains
    drawn together, the chains between two of one component, and the rings, which are components by themselves."""
    parts = dealt(edges)
    kind = edges.schema[UP].dataType.simpleString()
    found = parts.blocks.groupBy("block").applyInPandas(lambda rows: _strong(rows), f"job_id {kind}, label {kind}")
    if not parts.large.isEmpty():
        found = found.unionByName(_cyclic_components(parts.large))
    found = cut_lineage(found)
    if parts.chains is None:
        return found
    inner, ends, rings = parts.chains.inner, parts.chains.ends, parts.chains.rings
    start, end = (found.select(F.col("job_id").alias(c), "label") for c in ("start", "end"))
    between = ends.join(_merged(start), "start").join(_merged(end), ["end", "label"]).select("head", "label")
    return found.unionByName(inner.join(_merged(between), "head").select("job_id", "label")).unionByName(rings)


def has_cycle(edges: DataFrame) -> DataFrame:
    """One row: does the graph have a cycle?"""
    return cyclic_components(edges).agg((F.count("*") > 0).alias("has_cycle"))


def jobs_on_cycle(edges: DataFrame) -> DataFrame:
    """Jobs that are their own descendant."""
    return cyclic_components(edges).select("job_id")


def _cyclic_components(edges: DataFrame) -> DataFrame:
    """``(job_id, label)`` of the jobs on cycles, by strongly connected component.

    Without forming pairs: peel to the core, give every job the largest id that reaches it, then
    walk back from each job that kept its own id among the jobs of that id. What is met is one
    strongly connected component; take these out and repeat on what is left. Memory stays linear
    in the edges.
    """
    core = cyclic_core(edges)
    found = core.select(F.col(UP).alias("job_id"), F.col(UP).alias("label")).limit(0)
    while not core.isEmpty():
        label = _largest_reaching(core)
        component = _component_of_roots(core, label)
        members = component.groupBy("label").agg(F.count("*").alias("size"))
        loops = core.where(F.col(UP) == F.col(DOWN)).select(F.col(UP).alias("job_id"))
        cyclic = (
            component.join(_merged(members.where(F.col("size") > 1)), "label", "left_semi")
            .select("job_id", "label")
            .unionByName(component.select("job_id", "label").join(_merged(loops), "job_id", "left_semi"))
            .distinct()
        )
        found = cut_lineage(found.unionByName(cyclic))
        done = component.select("job_id")
        core = cyclic_core(
            core.join(_merged(done.withColumnRenamed("job_id", UP)), UP, "left_anti").join(
                _merged(done.withColumnRenamed("job_id", DOWN)), DOWN, "left_anti"
            )
        )
    return found


def _largest_reaching(core: DataFrame) -> DataFrame:
    """``(job_id, label)``: the largest id among the job itself and everything leading to it."""
    nodes = core.select(F.explode(F.array(UP, DOWN)).alias("job_id")).distinct()
    label = cut_lineage(nodes.withColumn("label", F.col("job_id")))
    changed = label
    while True:
        offers = (
            core.join(_merged(changed.withColumnRenamed("job_id", UP)), UP)
            .groupBy(F.col(DOWN).alias("job_id"))
            .agg(F.max("label").alias("offer"))
        )
        after = cut_lineage(
            label.join(_merged(offers), "job_id", "left").select(
                "job_id",
                F.greatest("label", "offer").alias("label"),
                F.coalesce(F.col("offer") > F.col("label"), F.lit(False)).alias("changed"),
            )
        )
        changed = after.where("changed").select("job_id", "label")
        label = after.select("job_id", "label")
        if changed.isEmpty():
            return label


def _component_of_roots(core: DataFrame, label: DataFrame) -> DataFrame:
    """``(job_id, label)`` of the jobs from which the job named by their label is reached inside
    the label's own set."""
    inner = cut_lineage(
        core.join(_merged(label.withColumnsRenamed({"job_id": UP, "label": "up_label"})), UP)
        .join(_merged(label.withColumnsRenamed({"job_id": DOWN, "label": "label"})), DOWN)
        .where(F.col("up_label") == F.col("label"))
        .select(UP, DOWN, "label")
    )
    frontier = cut_lineage(label.where(F.col("job_id") == F.col("label")))
    found, rounds = frontier, 0
    while True:
        step = (
            inner.join(_merged(frontier.select(F.col("job_id").alias(DOWN))), DOWN, "left_semi")
            .select(F.col(UP).alias("job_id"), "label")
            .distinct()
            .join(_merged(found), ["job_id", "label"], "left_anti")
        )
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            return found
        rounds += 1
        found = _grown(found, frontier, rounds)


def proposed_graph(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """The edges after the proposals: a job's new list replaces its old list on that side.

    ``proposed``: ``job_id, side ('upstream' | 'downstream'), other_job_id``; a null other empties
    the list."""
    edges = edges.select(UP, DOWN)
    replaced = proposed.select("job_id", "side").distinct()
    new_up = proposed.where("side = 'upstream' AND other_job_id IS NOT NULL").select(
        F.col("other_job_id").alias(UP), F.col("job_id").alias(DOWN)
    )
    new_down = proposed.where("side = 'downstream' AND other_job_id IS NOT NULL").select(
        F.col("job_id").alias(UP), F.col("other_job_id").alias(DOWN)
    )
    kept = edges.join(
        replaced.where("side = 'upstream'").select(F.col("job_id").alias(DOWN)), DOWN, "left_anti"
    ).join(replaced.where("side = 'downstream'").select(F.col("job_id").alias(UP)), UP, "left_anti")
    return kept.select(UP, DOWN).unionByName(new_up).unionByName(new_down).distinct()


def validate_edges(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """One row per job with a proposal: ``accepted`` unless the job would be its own descendant.

    A batch is judged as a whole, so of two proposals that close a cycle together both are refused; see :func:`accept_edges`
    for requests one after another."""
    cyclic = jobs_on_cycle(proposed_graph(edges, proposed)).withColumn("on_cycle", F.lit(True))
    return (
        proposed.select("job_id")
        .distinct()
        .join(cyclic, "job_id", "left")
        .select("job_id", F.col("on_cycle").isNull().alias("accepted"))
    )


REQUEST = ("job_id", "requested_at")


def _listed(requests: Iterable[tuple]) -> list[tuple]:
    """``(job, requested_at, {side: set of others})`` in the order of time, then job."""
    lists: dict[tuple, dict[str, set]] = {}
    for job, at, side, others in requests:
        lists.setdefault((at, job), {})[side] = set(others)
    return [(job, at, sides) for (at, job), sides in sorted(lists.items())]


def _judged(edges: pd.DataFrame, requests: pd.DataFrame) -> pd.DataFrame:
    """Take the requests of some components one after another; a refused one leaves the lists as they were."""
    below, above = defaultdict(set), defaultdict(set)
    for up, down in zip(edges[UP], edges[DOWN], strict=True):
        below[up].add(down)
        above[down].add(up)

    def put(job: Hashable, side: str, others: set) -> set:
        near, far = (above, below) if side == "upstream" else (below, above)
        old = near[job]
        for other in old:
            far[other].discard(job)
        for other in others:
            far[other].add(job)
        near[job] = others
        return old

    def returns(job: Hashable) -> bool:
        todo, seen = list(below[job]), set()
        while todo:
            at = todo.pop()
            if at == job:
                return True
            if at not in seen:
                seen.add(at)
                todo.extend(below[at])
        return False

    rows = []
    for job, at, sides in _listed(requests[["job_id", "requested_at", "side", "others"]].itertuples(index=False, name=None)):
        # One list after the other, and back in the opposite order: both may hold the job itself.
        old = [(side, put(job, side, others)) for side, others in sorted(sides.items(), reverse=True)]
        accepted = not returns(job)
        if not accepted:
            for side, others in reversed(old):
                put(job, side, others)
        rows.append((job, at, accepted))
    out = pd.DataFrame(rows, columns=["job_id", "requested_at", "accepted"])
    return out.astype({"job_id": requests["job_id"].dtype, "requested_at": requests["requested_at"].dtype})


def accept_edges(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """``(job_id, requested_at, accepted)``: dependency lists requested one after another.

    ``requests``: ``job_id, requested_at, side ('upstream' | 'downstream'), other_job_id``; the rows of one job and time are one
    request and give its new lists, a null other empties one. A request after which the job would be its own descendant is
    refused and changes nothing; those that follow are judged without it. Requests of one time count in the order of their jobs.

    Only jobs that are on a cycle of all edges together, those there are and those asked for, can be refused: their strongly
    connected components are dealt to tasks, the rest is accepted as it is. Should one have more than ``LOCAL`` edges, its requests are
    judged one by one over the whole component."""
    requests = cut_lineage(requests.select("job_id", "requested_at", "side", "other_job_id"))
    asked = requests.where(F.col("other_job_id").isNotNull())
    is_up = F.col("side") == "upstream"
    wanted = asked.select(
        F.when(is_up, F.col("other_job_id")).otherwise(F.col("job_id")).alias(UP), F.when(is_up, F.col("job_id")).otherwise(F.col("other_job_id")).alias(DOWN)
    )
    old = cut_lineage(edges.select(UP, DOWN).distinct())
    cyclic = cut_lineage(cyclic_components(old.unionByName(wanted)))
    labels = cyclic.select(F.col("job_id").alias(DOWN), F.col("label").alias("_label"))
    inner = old.join(cyclic.withColumnRenamed("job_id", UP), UP).join(labels, DOWN).where(F.col("label") == F.col("_label")).select(UP, DOWN, "label")
    risky = requests.join(cyclic, "job_id")
    lists = risky.groupBy("job_id", "requested_at", "side", "label").agg(F.collect_list("other_job_id").alias("others"))
    sizes = inner.select("label").unionByName(risky.select("label")).groupBy("label").agg(F.count("*").alias("n"))
    named = cut_lineage(sizes)
    large = named.where(F.col("n") > LOCAL).select("label")
    total = named.agg(F.sum("n")).first()[0] or 0
    block = F.pmod(F.xxhash64("label"), F.lit(total // (LOCAL // 2 + 1) + 1)).cast("int").alias("block")
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    schema = f"job_id {kinds['job_id']}, requested_at {kinds['requested_at']}, accepted boolean"
    judged = (
        inner.join(large, "label", "left_anti").select(UP, DOWN, block).groupBy("block")
        .cogroup(lists.join(large, "label", "left_anti").select("job_id", "requested_at", "side", "others", block).groupBy("block"))
        .applyInPandas(lambda lines, rows: _judged(lines, rows), schema)
    )
    if not large.isEmpty():
        judged = judged.unionByName(_one_by_one(inner.join(large, "label", "left_semi"), risky.join(large, "label", "left_semi")))
    verdict = cut_lineage(judged.select("job_id", "requested_at", "accepted"))
    every = requests.select(*REQUEST).distinct()
    return every.join(verdict, [*REQUEST], "left").select(*REQUEST, F.coalesce("accepted", F.lit(True)).alias("accepted"))


def _one_by_one(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests judged in turn, each over all edges."""
    edges, rows = edges.select(UP, DOWN), []
    for r in requests.select(*REQUEST).distinct().orderBy("requested_at", "job_id").toLocalIterator():
        own = requests.where((F.col("job_id") == r.job_id) & (F.col("requested_at") == r.requested_at))
        after = cut_lineage(proposed_graph(edges, own))
        accepted = descendants(after, own).where(F.col("job_id") == r.job_id).isEmpty()
        edges = after if accepted else edges
        rows.append(own.select(*REQUEST, F.lit(accepted).alias("accepted")).distinct())
    found = rows[0]
    for row in rows[1:]:
        found = found.unionByName(row)
    return cut_lineage(found)


def edges_after(edges: DataFrame, requests: DataFrame, verdict: DataFrame) -> DataFrame:
    """The edges when the accepted ones of :func:`accept_edges` have been taken in order. An edge is in two lists, that of
    its upstream and that of its downstream job; the one set last says whether it is there."""
    taken = requests.join(verdict.where("accepted").select(*REQUEST), [*REQUEST], "left_semi")
    last = taken.groupBy("job_id", "side").agg(F.max("requested_at").alias("requested_at"))
    lists = taken.join(last, ["job_id", "side", "requested_at"], "left_semi").where(F.col("other_job_id").isNotNull())
    ups = lists.where("side = 'upstream'").select(F.col("other_job_id").alias(UP), F.col("job_id").alias(DOWN), F.lit(True).alias("in_up"))
    downs = lists.where("side = 'downstream'").select(F.col("job_id").alias(UP), F.col("other_job_id").alias(DOWN), F.lit(True).alias("in_down"))
    every = edges.select(UP, DOWN).withColumn("was", F.lit(True)).distinct()
    every = every.join(ups.distinct(), [UP, DOWN], "full").join(downs.distinct(), [UP, DOWN], "full")

    def set_at(side: str, job: str) -> DataFrame:
        return last.where(F.col("side") == side).select(F.col("job_id").alias(job), F.struct("requested_at", F.col("job_id").alias("job")).alias(f"{side}_at"))

    every = every.join(set_at("upstream", DOWN), DOWN, "left").join(set_at("downstream", UP), UP, "left")
    up, down = F.col("upstream_at"), F.col("downstream_at")
    # Of one request with both lists either names the edge.
    there = (
        F.when(up.isNull() & down.isNull(), F.col("was"))
        .when(down.isNull() | (up > down), F.col("in_up"))
        .when(up.isNull() | (down > up), F.col("in_down"))
        .otherwise(F.coalesce("in_up", "in_down"))
    )
    return every.where(F.coalesce(there, F.lit(False))).select(UP, DOWN)


def neighbourhood_nodes(job_id, jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """The job with its direct neighbours: ``job_id, kind, name``; the name is null when unknown."""
    job = F.lit(job_id)
    near = edges.where((F.col(UP) == job) | (F.col(DOWN) == job)).where(F.col(UP) != F.col(DOWN))
    nodes = (
        near.select(
            F.when(F.col(DOWN) == job, F.col(UP)).otherwise(F.col(DOWN)).alias("job_id"),
            F.when(F.col(DOWN) == job, "upstream").otherwise("downstream").alias("kind"),
        )
        .unionByName(jobs.where(F.col("job_id") == job).select("job_id", F.lit("current").alias("kind")))
        .distinct()
    )
    return nodes.join(jobs.select("job_id", "name"), "job_id", "left")


def neighbourhood_edges(job_id, edges: DataFrame) -> DataFrame:
    """The edges between a job and its direct neighbours."""
    job = F.lit(job_id)
    return (
        edges.select(UP, DOWN)
        .where(((F.col(UP) == job) | (F.col(DOWN) == job)) & (F.col(UP) != F.col(DOWN)))
        .distinct()
    )


def candidates(successes: DataFrame, edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """Enabled jobs downstream of the given successful runs, each once."""
    sources = successes.select(F.col("job_id").alias(UP)).distinct()
    below = edges.join(sources, UP, "left_semi").select(F.col(DOWN).alias("job_id")).distinct()
    return jobs.where(F.col("enabled")).select("job_id").join(below, "job_id", "left_semi")


def candidate_set(successes: DataFrame, edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """The candidates together with all their upstreams: the jobs whose latest run matters."""
    below = candidates(successes, edges, jobs)
    above = edges.join(below.withColumnRenamed("job_id", DOWN), DOWN, "left_semi").select(
        F.col(UP).alias("job_id")
    )
    return below.unionByName(above).distinct()
