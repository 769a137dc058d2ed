"""Graph operators as iterated joins.

Every round is written to the shared folder, which cuts the lineage and
survives the loss of executors; the stored table also tells Spark its size for
the next join. Rounds use joins and aggregates that combine map-side, so hubs
stay harmless; searches from many nodes work on blocks of links (``blocks``).
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.core import bounded_broadcast, join_on_keys, shuffles_freed, store_and_reload, with_group_totals, with_table_scalars
from tallyloom.operators import blocks
from tallyloom.operators.aggregate import most_frequent
from tallyloom.operators.sequence import sequence_columns

def keep(df: DataFrame) -> DataFrame:
    """Store the result of a round and go on from the stored table; its shuffle files are removed."""
    with shuffles_freed(df.sparkSession):
        return store_and_reload(df, "graph")


# --- tables ---------------------------------------------------------------------


def node_table(edges: DataFrame, attributes: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Nodes of an edge list, with attributes joined on."""
    nodes = edges.select(F.col("src").alias(key)).union(edges.select(F.col("dst"))).distinct()
    return nodes if attributes is None else nodes.join(attributes, key, "left")


def both_directions(edges: DataFrame) -> DataFrame:
    """Undirected edges as rows in both directions, loops and repeats removed."""
    return _directions(edges).distinct()


def _directions(edges: DataFrame) -> DataFrame:
    plain = edges.select("src", "dst").filter("src <> dst")
    return plain.union(plain.select(F.col("dst"), F.col("src")))


def _linked(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links in both directions and their nodes, each made once and stored."""
    links = keep(_clustered(_directions(edges)).distinct())  # ranges hold all repeats of a link: no second shuffle
    return links, keep(links.select(F.col("src").alias("id")).distinct())


def _clustered(links: DataFrame) -> DataFrame:
    """Links in ranges of their first node, so that sums per node are nearly whole before they are shuffled.

    Ranges go on to the second node, so a hub is several of them.
    """
    return links.repartitionByRange("src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def density(edges: DataFrame) -> DataFrame:
    """Share of possible undirected edges that exist, loops not counted."""
    links = both_directions(edges)
    n = links.agg(F.count_distinct("src").alias("n_nodes"), (F.count("*") / 2).cast("long").alias("n_edges"))
    return n.withColumn(
        "density", 2 * F.col("n_edges") / (F.col("n_nodes").cast("double") * (F.col("n_nodes") - 1))
    )


def induced_subgraph(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges with both ends in the node table."""
    ids = nodes.select(key)
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed(key, end), end, "left_semi")
    return edges


def rule_edges(df: DataFrame, text: str, noun: str = "bag") -> DataFrame:
    """Rules such as "red bags contain 2 blue bags, 1 tan bag." to edges.

    Rules without content ("no other bags") give no edge.
    """
    sides = F.split(F.col(text), f" {noun}s? contain ", 2)
    rows = df.select(F.get(sides, 0).alias("src"), F.explode(F.split(F.get(sides, 1), ", ?")).alias("__c"))
    pattern = rf"^(\d+) (.+?) {noun}s?\.?$"
    return rows.filter(F.col("__c").rlike(pattern)).select(
        "src",
        F.regexp_extract("__c", pattern, 2).alias("dst"),
        F.regexp_extract("__c", pattern, 1).cast("long").alias("n"),
    )


# --- components ------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Weakly connected components; the label is the smallest node id.

    Alternates the large-star and small-star steps, which reach a fixed point
    in a logarithmic number of rounds. Each step is a grouped minimum and a
    join on the node.
    """
    nodes = node_table(edges)
    pairs = keep(
        edges.filter("src <> dst").select(
            F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
        ).distinct()
    )

    def fingerprint(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    mark = fingerprint(pairs)
    for _ in range(max_rounds):
        # large star: neighbours above a node move to the smallest neighbour
        both = pairs.union(pairs.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = moved.filter("u <> v").distinct()
        # small star: lower neighbours and the node itself move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u <> v").union(low.select("u", F.col("m"))).distinct()
        pairs = keep(small)
        new_mark = fingerprint(pairs)
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError("components did not converge")
    labels = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return nodes.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("n_nodes"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges inside the component with most nodes (ties: smallest label)."""
    labels = keep(components(edges))
    best = most_frequent(labels, "component").select("component")
    return induced_subgraph(edges, labels.join(best, "component", "left_semi"))


# --- paths -------------------------------------------------------------------------


def _blocked(links: DataFrame, sources: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, at, size of their component, w), numbered component by component, and the links between blocks of them.

    ``w`` groups the components that a task searches whole by the block in
    which they start; it is NULL in larger ones.
    """
    labels = components(links)
    if sources is not None:  # a source without links is a component of its own
        ids = labels.select("id").union(sources.select("id")).distinct()
        labels = join_on_keys(ids, labels, ["id"], "left").select("id", F.coalesce("component", "id").alias("component"))
    nodes = sequence_columns(keep(labels), [], ["component", "id"], position="at").withColumn("at", F.col("at") - 1)
    nodes = with_group_totals(keep(nodes), ["component"], F.count(F.lit(1)).alias("size"), F.min("at").alias("__first"))
    w = F.when(F.col("size") <= blocks.WHOLE_NODES, F.floor(F.col("__first") / blocks.BLOCK))
    nodes = keep(nodes.select("id", "at", "size", w.alias("w")))
    return nodes, blocks.link_blocks(links, nodes)


def _named(rows: DataFrame, nodes: DataFrame, at: str, end: str) -> DataFrame:
    """Positions ``at`` replaced by the nodes, so far as the nodes are few by copies of their table in all tasks."""
    names = nodes.select(F.col("id").alias(end), F.col("at").alias(at))
    return rows.join(bounded_broadcast(names, nodes.count()), at).drop(at)


def distance_profile(
    edges: DataFrame, targets: DataFrame | None = None, directed: bool = False, pass_sources: int | None = None
) -> DataFrame:
    """(id, dist, n): how many nodes (or ``targets``) lie ``dist`` steps from each node, 0 for itself.

    All searches run at once, 1,024 to a row of a block of nodes; no pair of
    nodes is ever a row.
    """
    links = edges.select("src", "dst").distinct() if directed else both_directions(edges)
    links = keep(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))  # searched from the targets
    nodes, tiles = _blocked(links, targets)
    whole, passes = blocks.source_parts(nodes, nodes if targets is None else targets, blocks.BLOCK, pass_sources)
    found = None
    if whole is not None:
        found = keep(blocks.whole_reach(tiles, whole).groupBy("at", "dist").agg(F.sum("n").alias("n")))
    tiles = tiles.filter("w IS NULL").drop("w")
    for part in passes:
        for dist, level in enumerate(blocks.reach_levels(tiles, part)):
            counts = blocks.node_sums(level, "n", "n").select("at", F.lit(dist).alias("dist"), "n")
            found = counts if found is None else found.union(counts)
        found = keep(found.groupBy("at", "dist").agg(F.sum("n").alias("n"))) if found is not None else None
    if found is None:
        return node_table(links).select("id", F.lit(0).alias("dist"), F.lit(0).cast("long").alias("n")).limit(0)
    return found.join(nodes, "at").select("id", "dist", "n")


def shortest_paths(
    edges: DataFrame, sources: DataFrame | None = None, directed: bool = False, max_depth: int | None = None,
    pass_sources: int | None = None,
) -> DataFrame:
    """(source, id, dist, paths) from the sources (default: all nodes) to every reached node.

    The search goes on until nothing new is reached; with ``max_depth`` it
    raises where paths are longer.
    """
    links = edges if directed else both_directions(edges)
    links = keep(links.select("src", "dst").distinct())
    nodes, tiles = _blocked(links, sources)
    whole, passes = blocks.source_parts(nodes, nodes if sources is None else sources, blocks.LANES, pass_sources)
    found = None
    if whole is not None:
        found = blocks.whole_paths(tiles, whole)
        if max_depth is not None:
            found = keep(found)
            if not found.filter(F.col("dist") > max_depth).isEmpty():
                raise RuntimeError("paths are longer than max_depth")
    tiles = tiles.filter("w IS NULL").drop("w")
    for part in passes:
        for dist, level in enumerate(blocks.path_levels(tiles, part)):
            if max_depth is not None and dist > max_depth:
                raise RuntimeError("paths are longer than max_depth")
            rows = blocks.path_rows(level).select("source", "at", F.lit(dist).alias("dist"), "paths")
            found = rows if found is None else found.union(rows)
    if found is None:
        return nodes.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist"), F.lit(0.0).alias("paths")).limit(0)
    rows = _named(_named(found, nodes, "at", "id"), nodes, "source", "__source")
    return rows.select(F.col("__source").alias("source"), "id", "dist", "paths")


def path_profile(paths: DataFrame) -> DataFrame:
    """The distance profile of the sources of a path table."""
    return paths.groupBy(F.col("source").alias("id"), "dist").agg(F.count("*").alias("n"))


def eccentricity(profile: DataFrame) -> DataFrame:
    """Distance of each node's farthest reached node."""
    return profile.groupBy("id").agg(F.max("dist").alias("eccentricity"))


def diameter(profile: DataFrame) -> DataFrame:
    """Longest shortest path, and the ratio of largest to least eccentricity."""
    ecc = eccentricity(profile)
    return ecc.agg(
        F.max("eccentricity").alias("diameter"),
        (F.max("eccentricity") / F.min("eccentricity")).alias("eccentricity_ratio"),
    )


def closeness(profile: DataFrame) -> DataFrame:
    """Normalised closeness over the nodes that each node reaches."""
    sums = profile.groupBy("id").agg((F.sum("n") - 1).alias("__n"), F.sum(F.col("n") * F.col("dist")).alias("__d"))
    return sums.select("id", F.when(F.col("__d") > 0, F.col("__n") / F.col("__d")).alias("closeness"))


def betweenness(
    edges: DataFrame, sources: DataFrame | None = None, pass_sources: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Betweenness of nodes and of undirected edges.

    Forward levels count shortest paths, 256 sources to a row of a block of
    nodes; the reverse pass hands dependencies from each level to the one
    before. Passes are summed. Fewer sources give a sample. Either table
    searches small components again.
    """
    links = keep(both_directions(edges))
    nodes, tiles = _blocked(links, sources)
    whole, passes = blocks.source_parts(nodes, nodes if sources is None else sources, blocks.LANES, pass_sources)
    node_parts, edge_parts = [], []
    if whole is not None:
        node_parts.append(blocks.whole_dependencies(tiles, whole))
        edge_parts.append(blocks.whole_flows(tiles, whole))
    tiles = tiles.filter("w IS NULL").drop("w")
    for part in passes:
        levels = list(blocks.path_levels(tiles, part))
        if len(levels) < 2:
            continue
        low = blocks.last_shares(levels[-1])
        for depth in range(len(levels) - 1, 0, -1):
            edge_parts.append(blocks.link_flows(tiles, low, levels[depth - 1]))
            if depth > 1:
                low = blocks.shares_above(tiles, low, levels[depth - 1])
                node_parts.append(blocks.node_sums(low, "d", "c"))

    def total(parts, *keys):
        rows = functools.reduce(DataFrame.union, parts)
        return rows.groupBy(*keys).agg((F.sum("c") / 2).alias("betweenness"))

    edge_scores = links.withColumn("betweenness", F.lit(0.0)).limit(0)
    if edge_parts:
        flows = total([p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "c") for p in edge_parts], "a", "b")
        flows = _named(_named(flows, nodes, "a", "src"), nodes, "b", "dst")
        edge_scores = flows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "betweenness")
    own = node_table(links)
    if not node_parts:
        return own.withColumn("betweenness", F.lit(0.0)), edge_scores
    scores = _named(total(node_parts, "at"), nodes, "at", "id")
    return own.join(scores, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness")), edge_scores


def eigenvector(
    edges: DataFrame, tolerance: float = 1e-10, scale: bool = True, check_every: int = 8, max_rounds: int = 10_000
) -> DataFrame:
    """Eigenvector centrality by power iteration, scaled to maximum 1 or length 1.

    Iterating with A + I has the same eigenvectors and does not oscillate on
    bipartite graphs. Ends when no score changes by more than ``tolerance``
    over ``check_every`` rounds; raises where ``max_rounds`` are not enough.
    """
    links, nodes = _linked(edges)
    links = links.union(nodes.select("id", "id"))
    x = keep(nodes.withColumn("x", F.lit(1.0)))
    for _ in range(0, max_rounds, check_every):
        before = x.withColumnRenamed("x", "__old")
        for _ in range(check_every):  # stored, so the next join knows its size and no round is run twice
            x = keep(links.join(x, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("id")).agg(F.sum("x").alias("x")))
        top = x.agg(F.max("x").alias("__top"))
        x = keep(with_table_scalars(x, top).select("id", (F.col("x") / F.col("__top")).alias("x")))
        change = x.join(before, "id").agg(F.max(F.abs(F.col("x") - F.col("__old")))).first()[0]
        if change is None or change <= tolerance:
            break
    else:
        raise RuntimeError("scores did not settle within max_rounds")
    if not scale:
        norm = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("__l"))
        x = with_table_scalars(x, norm).select("id", (F.col("x") / F.col("__l")).alias("x"))
    return x.withColumnRenamed("x", "eigen")


# --- communities and roles -----------------------------------------------------------


def label_communities(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Label propagation: a node takes the most frequent label around it.

    The node's own label takes part with one vote; the smallest label wins ties.
    ``rounds`` asks for that many rounds at most; without it, propagation goes on
    until labels stay, or until they swing between two states, of which each
    node then keeps its smaller label.
    """
    links, nodes = _linked(edges)
    votes = links.union(nodes.select("id", "id"))
    labels = keep(nodes.withColumn("community", F.col("id")))
    before = None
    for i in itertools.count(1):
        tally = (
            votes.join(labels, F.col("dst") == F.col("id"))
            .groupBy("src", "community")
            .agg(F.count("*").alias("n"))
        )
        best = F.min_by("community", F.struct(-F.col("n"), F.col("community")))
        new = keep(tally.groupBy(F.col("src").alias("id")).agg(best.alias("community")))
        other = lambda x: new.join(x.withColumnRenamed("community", "__old"), "id")
        stable = other(labels).filter("community <> __old").isEmpty()
        swings = before is not None and not stable and other(before).filter("community <> __old").isEmpty()
        if swings and rounds is None:
            return other(labels).select("id", F.least("community", "__old").alias("community"))
        before, labels = labels, new
        if stable or i == rounds:
            break
    return labels


def modularity(links: DataFrame, labels: DataFrame) -> float:
    """Modularity of a partition: ``links`` (src, dst, w) in both directions, loops once; ``labels`` (id, community)."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("community").alias(f"__{end}"))
    both = links.join(of("src"), "src").join(of("dst"), "dst")
    per = both.groupBy(F.col("__src").alias("c")).agg(
        F.sum("w").alias("tot"), F.sum(F.when(F.col("__src") == F.col("__dst"), F.col("w")).otherwise(0.0)).alias("own")
    )
    whole, own, square = per.agg(F.sum("tot"), F.sum("own"), F.sum(F.col("tot") * F.col("tot"))).first()
    return own / whole - square / whole**2 if whole else 0.0


def _best_moves(links: DataFrame, labels: DataFrame, degree: DataFrame, whole: float) -> DataFrame:
    """(id, community, target, gain): each node's best neighbouring community, where modularity would rise.

    The gain of a move is (k_in - k_in_own) / W - k * (tot - tot_own + k) / W**2,
    times 2; ties go by hash of the community.
    """
    # a row per node or community: stored, so the joins of a row per link know how small they are
    node = keep(labels.join(degree, "id").select("id", "community", "k"))
    tot = keep(node.groupBy("community").agg(F.sum("k").alias("tot")))
    of = labels.select(F.col("id").alias("dst"), F.col("community").alias("target"))
    near = links.filter("src <> dst").join(of, "dst").groupBy(F.col("src").alias("id"), "target").agg(F.sum("w").alias("k_in"))
    moves = near.join(node, "id")
    k_own = F.coalesce(F.max(F.when(F.col("target") == F.col("community"), F.col("k_in"))), F.lit(0.0))
    # k_in_own, k and tot_own are the same for all of a node's targets, so the best target needs only its own part,
    # and tot_own is looked up for the nodes that are left
    moves = moves.join(tot.withColumnRenamed("community", "target"), "target")
    worth = F.when(F.col("target") != F.col("community"), F.col("k_in") / whole - F.col("k") * F.col("tot") / whole**2)
    best = moves.groupBy("id", "community", "k").agg(
        F.max(F.when(worth.isNotNull(), F.struct(worth.alias("worth"), F.xxhash64("target").alias("h"), "target"))).alias("b"), k_own.alias("k_own")
    ).join(tot.withColumnRenamed("tot", "tot_own"), "community")
    gain = 2 * (F.col("b.worth") - F.col("k_own") / whole - F.col("k") * (F.col("k") - F.col("tot_own")) / whole**2)
    return best.filter("b IS NOT NULL").select("id", "community", "b.target", gain.alias("gain")).filter("gain > 1e-12")


def _apart(moves: DataFrame) -> DataFrame:
    """Moves that share no community with a better one; together they gain what they gain one by one."""
    rank = F.struct("gain", F.xxhash64("id").alias("h"), "id")
    touch = moves.select(F.explode(F.array("community", "target")).alias("c"), rank.alias("r"))
    top = touch.groupBy("c").agg(F.max("r").alias("__top"))
    for end in ("community", "target"):
        moves = moves.join(top.withColumnsRenamed({"c": end, "__top": f"__{end}"}), end)
    return moves.filter((F.col("__community.id") == F.col("id")) & (F.col("__target.id") == F.col("id"))).select("id", "community", "target", "gain")


def _local_moving(links: DataFrame, labels: DataFrame, least: float) -> tuple[DataFrame, float]:
    """Moves nodes until a round raises modularity by less than ``least``.

    Half of the nodes, by hash, move at a time; where that does not raise
    modularity, only moves that do not touch each other are made, which must.
    """
    degree = keep(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    whole = degree.agg(F.sum("k")).first()[0]
    if not whole:
        return labels, 0.0
    q = modularity(links, labels)
    for turn in itertools.count():
        moves = keep(_best_moves(links, labels, degree, whole))
        if moves.isEmpty():
            return labels, q
        half = moves.filter(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0)
        for some in (half, _apart(moves)):
            new = labels.join(some.select("id", "target"), "id", "left").select("id", F.coalesce("target", "community").alias("community"))
            new = keep(new)
            after = modularity(links, new)
            if after > q + least:
                labels, q = new, after
                break
        else:
            return (new, after) if after > q else (labels, q)


def louvain_communities(edges: DataFrame, weight: str | None = None, least: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """Communities by local moving and contraction: (id, community), and (level, n_communities, modularity).

    Nodes move to the neighbouring community with the largest gain of
    modularity until a round gains less than ``least``; communities then become
    the nodes of the next level, with summed edges and loops, until a level
    gains less than that.
    Modularity never falls. A community is named by its smallest node. Parallel
    edges add up, loops and edges without a positive weight are left out.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    plain = edges.select("src", "dst", w.alias("w")).filter("src <> dst AND w > 0")
    links = keep(_clustered(plain.union(plain.select("dst", "src", "w"))).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    labels = keep(node_table(links).withColumn("community", F.col("id")))  # of the first nodes
    history = []
    for level in itertools.count(1):
        own = keep(node_table(links).withColumn("community", F.col("id")))
        moved, q = _local_moving(links, own, least)
        names = moved.groupBy("community").agg(F.min("id").alias("__name"))
        moved = keep(moved.join(names, "community").select("id", F.col("__name").alias("community")))
        n, before = moved.select("community").distinct().count(), moved.count()
        history.append((level, n, float(q)))
        if n == before:
            break
        up = moved.select(F.col("id").alias("community"), F.col("community").alias("__up"))
        labels = keep(labels.join(up, "community").select("id", F.col("__up").alias("community")))
        if level > 1 and q - history[-2][2] < least:
            break
        of = lambda end: moved.select(F.col("id").alias(end), F.col("community").alias(f"__{end}"))
        both = links.join(of("src"), "src").join(of("dst"), "dst")
        links = keep(_clustered(both.groupBy(F.col("__src").alias("src"), F.col("__dst").alias("dst")).agg(F.sum("w").alias("w"))))
    spark = edges.sparkSession
    return labels, spark.createDataFrame(history, "level int, n_communities long, modularity double")


def community_sizes(labels: DataFrame) -> DataFrame:
    """(community, n_nodes)."""
    return labels.groupBy("community").agg(F.count("*").alias("n_nodes"))


def split_communities(edges: DataFrame, parts: int, max_removed: int = 50) -> DataFrame:
    """Communities by removing the edge with most shortest paths, again and again.

    Every removal recomputes all paths, so this is for single small components;
    use :func:`label_communities` on large graphs.
    """
    nodes = keep(node_table(edges))
    rest = keep(
        edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    )
    for _ in range(max_removed):
        found = components(rest)
        labels = keep(
            nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("community"))
        )
        if labels.select("community").distinct().count() >= parts:
            return labels
        _, scores = betweenness(rest)
        worst = scores.orderBy(F.desc("betweenness"), "src", "dst").limit(1).select("src", "dst")
        rest = keep(rest.join(worst, ["src", "dst"], "left_anti"))
    raise RuntimeError("graph was not split within max_removed removals")


def role_labels(scores: DataFrame, between: str, eigen: str, share: float = 0.75) -> DataFrame:
    """Gatekeepers (high betweenness, low eigenvector) and accessors (reverse)."""
    from tallyloom.operators.quantiles import exact_quantiles

    cb = exact_quantiles(scores, [], between, {"__b": share})
    ce = exact_quantiles(scores, [], eigen, {"__e": share})
    both = with_table_scalars(with_table_scalars(scores, cb), ce)
    high_b, high_e = F.col(between) >= F.col("__b"), F.col(eigen) >= F.col("__e")
    role = F.when(high_b & ~high_e, "gatekeeper").when(~high_b & high_e, "accessor").otherwise("other")
    return both.withColumn("role", role).drop("__b", "__e")


# --- directed graphs --------------------------------------------------------------------


def reachable(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes that can be reached from each source along directed edges.

    The search goes on until nothing new is reached; with ``max_depth`` it
    raises where nodes lie deeper.
    """
    links = keep(edges.select("src", "dst").distinct())
    frontier = keep(sources.select(F.col("id").alias("source"), "id").distinct())
    seen = frontier
    for depth in itertools.count(1):
        step = (
            frontier.join(links, F.col("id") == F.col("src"))
            .select("source", F.col("dst").alias("id"))
            .distinct()
            .join(seen, ["source", "id"], "left_anti")
        )
        frontier = keep(step)
        if frontier.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            raise RuntimeError("nodes lie deeper than max_depth")
        seen = seen.union(frontier)
    return seen.join(sources.select(F.col("id").alias("source"), "id"), ["source", "id"], "left_anti")


def contained_totals(edges: DataFrame, sources: DataFrame, max_depth: int = 100) -> DataFrame:
    """Weighted number of items below each source of an acyclic graph.

    Sums, over all paths, the product of the edge quantities. Paths that meet
    in a node are merged level by level, so they are never enumerated.
    """
    links = keep(edges.select("src", "dst", F.col("n").cast("double").alias("n")))
    level = keep(sources.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("q")))
    totals = None
    for _ in range(max_depth):
        level = keep(
            level.join(links, F.col("id") == F.col("src"))
            .groupBy("source", F.col("dst").alias("id"))
            .agg(F.sum(F.col("q") * F.col("n")).alias("q"))
        )
        if level.isEmpty():
            break
        part = level.groupBy("source").agg(F.sum("q").alias("q"))
        totals = part if totals is None else totals.union(part)
    else:
        raise RuntimeError("the graph has a cycle or is deeper than max_depth")
    if totals is None:
        return sources.select(F.col("id").alias("source"), F.lit(0.0).alias("total"))
    return totals.groupBy("source").agg(F.sum("q").alias("total"))


def connected_pairs(counts: DataFrame, sd_above: float) -> DataFrame:
    """Edges whose count is more than ``sd_above`` standard deviations above the mean."""
    floor = counts.agg((F.avg("n") + sd_above * F.stddev_samp("n")).alias("f"))
    return counts.filter(F.col("n") > floor.scalar()).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), "n"
    )


def top_central(scores: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    return scores.orderBy(*[F.desc(b) for b in by], F.asc("id")).limit(k)
