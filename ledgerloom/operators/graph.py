"""The transfer graph: collapsed edges, structural roles, hop-decay propagation, evidence per group, communities."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.numeric import div, div0
from ledgerloom.sources.io import written

#: Fixed values of the ring and propagation definitions.
SIZES, MAX_CYCLE, MAX_CONDUCTANCE, MIN_DENSITY = (3, 25), 5, 0.60, 0.15
MAX_REFINE = 6
DECAY = {1: 0.85, 2: 0.70, 3: 0.55}


def collapse(edges: DataFrame) -> DataFrame:
    """src, dst, weight, amount: parallel edges in one, loops dropped; a missing amount counts 1."""
    amount = F.coalesce(F.col("amount").cast("double"), F.lit(1.0)) if "amount" in edges.columns else F.lit(1.0)
    return edges.select("src", "dst", amount.alias("amount")).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"), F.sum("amount").alias("amount"))


def edges_of_columns(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """src, dst: row `key` (0..n-1) points to the rows that its `columns` name; other values, blanks and loops are no edges."""
    n = rows.count()
    cells = rows.select(F.col(key).cast("long").alias("src"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["src"], columns, "column", "x")
    cells = cells.filter(F.col("x").isNotNull() & ~F.isnan("x")).withColumn("dst", F.col("x").cast("long"))
    return cells.filter(F.col("dst").between(0, n - 1) & (F.col("dst") != F.col("src"))).select("src", "dst")


def undirected(graph: DataFrame) -> DataFrame:
    return graph.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def roles(graph: DataFrame) -> DataFrame:
    """account, ind, outd, inflow, outflow, role; the first rule that holds decides."""
    both = F.array(F.struct(F.col("src").alias("account"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0.0).alias("ai"), F.col("amount").alias("ao")), F.struct(F.col("dst").alias("account"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("amount").alias("ai"), F.lit(0.0).alias("ao")))
    d = graph.select(F.explode(both).alias("e")).select("e.*").groupBy("account").agg(F.sum("i").alias("ind"), F.sum("o").alias("outd"), F.sum("ai").alias("inflow"), F.sum("ao").alias("outflow"))
    held = div(F.abs(F.col("inflow") - F.col("outflow")), F.col("inflow") + F.col("outflow"))
    role = (
        F.when((F.col("ind") == 0) & (F.col("outd") == 0), "ISOLATED").when(F.col("ind") == 0, "SOURCE").when(F.col("outd") == 0, "TERMINAL")
        .when(F.coalesce(held, F.lit(1.0)) < 0.15, "RELAY").when(F.col("ind") >= 3 * F.col("outd"), "COLLECTOR").when(F.col("outd") >= 3 * F.col("ind"), "DISPERSER").otherwise("ORDINARY")
    )
    return d.withColumn("role", role)


def propagate(graph: DataFrame, seeds: DataFrame, decay: dict[int, float] = DECAY) -> DataFrame:
    """account, hop, score: breadth-first from the seeds over undirected edges, at most len(decay) hops.

    Links and frontiers are written once, so that no hop computes the ones before it anew.
    """
    u = undirected(graph)
    both = written(u.unionByName(u.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links")
    seen = seeds.select("account").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in sorted(decay):
        reach = frontier.join(both, frontier["account"] == both["u"]).select(F.col("v").alias("account")).distinct().join(seen, "account", "left_anti")
        frontier = written(reach.withColumn("hop", F.lit(hop)), "frontier")
        seen = seen.unionByName(frontier)
    score = F.lit(1.0)
    for hop, s in decay.items():
        score = F.when(F.col("hop") == hop, F.lit(s)).otherwise(score)
    return seen.withColumn("score", score)


def hop_evaluation(reached: DataFrame, truth: DataFrame) -> DataFrame:
    """Per hop: accounts reached, true ones, precision; running recall and precision over hops (seeds apart)."""
    r = reached.filter("hop > 0").join(truth.select("account", F.lit(1).alias("hit")), "account", "left")
    by = r.groupBy("hop").agg(F.count("*").alias("reached"), F.count("hit").alias("hits"))
    run = Window.orderBy("hop")
    total = truth.join(reached.filter("hop = 0"), "account", "left_anti").agg(F.count("*").alias("all"))
    by = by.withColumn("cum_reached", F.sum("reached").over(run)).withColumn("cum_hits", F.sum("hits").over(run)).crossJoin(F.broadcast(total))
    return by.select("hop", "reached", "hits", F.round(div0(F.col("hits"), F.col("reached")), 6).alias("precision"), F.round(div0(F.col("cum_hits"), F.col("cum_reached")), 6).alias("cum_precision"), F.round(div0(F.col("cum_hits"), F.col("all")), 6).alias("cum_recall"))


def density(graph: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, size, internal (directed edges inside), density."""
    inside = _inside(graph, groups).groupBy("grp").agg(F.count("*").alias("internal"))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("size"))
    return sizes.join(inside, "grp", "left").select("grp", "size", F.coalesce("internal", F.lit(0)).alias("internal"), div0(F.coalesce("internal", F.lit(0)), F.col("size") * (F.col("size") - 1)).alias("density"))


def _inside(graph: DataFrame, groups: DataFrame) -> DataFrame:
    a, b = groups.select(F.col("account").alias("src"), F.col("grp")), groups.select(F.col("account").alias("dst"), F.col("grp").alias("grp2"))
    return graph.join(a, "src").join(b, "dst").filter("grp = grp2").select("grp", "src", "dst", "amount")


def conductance(graph: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, conductance: boundary over the smaller volume, on undirected edges; 1 where degenerate."""
    u = undirected(graph)
    degree = u.select(F.explode(F.array("u", "v")).alias("account")).groupBy("account").agg(F.count("*").alias("degree"))
    vol = groups.join(degree, "account", "left").groupBy("grp").agg(F.sum(F.coalesce("degree", F.lit(0))).alias("vol"))
    a, b = groups.select(F.col("account").alias("u"), "grp"), groups.select(F.col("account").alias("v"), F.col("grp").alias("grp2"))
    inner = u.join(a, "u").join(b, "v").filter("grp = grp2").groupBy("grp").agg(F.count("*").alias("inner"))
    total = u.agg((2 * F.count("*")).alias("total"))
    x = vol.join(inner, "grp", "left").crossJoin(F.broadcast(total)).withColumn("inner", F.coalesce("inner", F.lit(0)))
    small = F.least("vol", F.col("total") - F.col("vol"))
    value = F.when(small <= 0, F.lit(1.0)).otherwise(div0(F.greatest(F.col("vol") - 2 * F.col("inner"), F.lit(0)), small, 1.0))
    return x.select("grp", value.alias("conductance"))


def cycles(graph: DataFrame, groups: DataFrame, longest: int = MAX_CYCLE) -> DataFrame:
    """grp, cycles: simple directed cycles of 2..longest accounts inside a group, each counted at its smallest account.

    Bounded self-joins inside groups that passed the size gate, so paths stay few.
    """
    sized = groups.join(groups.groupBy("grp").agg(F.count("*").alias("k")).filter(F.col("k").between(*SIZES)), "grp", "left_semi")
    e = _inside(graph, sized).select("grp", "src", "dst")
    path = e.filter("dst > src").select("grp", F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    found = None
    step = e.select("grp", F.col("src").alias("last"), F.col("dst").alias("next"))
    for k in range(2, longest + 1):
        on = path.join(step, ["grp", "last"])
        closed = on.filter("next = first").groupBy("grp").agg(F.count("*").alias("n"))
        found = closed if found is None else found.unionByName(closed)
        if k < longest:
            path = on.filter("next > first").filter(~F.array_contains("path", F.col("next"))).select("grp", "first", F.col("next").alias("last"), F.concat("path", F.array("next")).alias("path"))
    total = found.groupBy("grp").agg(F.sum("n").alias("n"))
    return sized.select("grp").distinct().join(total, "grp", "left").select("grp", F.coalesce("n", F.lit(0)).alias("cycles"))


def group_passthrough(graph: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, inflow, outflow over the boundary, passthrough = min(out / in, 1), 0 without inflow."""
    a, b = groups.select(F.col("account").alias("src"), "grp"), groups.select(F.col("account").alias("dst"), "grp")
    # groups may overlap, so an edge crosses a group's boundary if its other end is not in that same group
    out = graph.join(a, "src").join(b, ["dst", "grp"], "left_anti").groupBy("grp").agg(F.sum("amount").alias("outflow"))
    inn = graph.join(b, "dst").join(a, ["src", "grp"], "left_anti").groupBy("grp").agg(F.sum("amount").alias("inflow"))
    g = groups.select("grp").distinct().join(inn, "grp", "left").join(out, "grp", "left").fillna(0.0, ["inflow", "outflow"])
    return g.withColumn("passthrough", F.least(div0(F.col("outflow"), F.col("inflow")), F.lit(1.0)))


def role_evidence(graph: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, role_evidence: a third for a collector or disperser, for a relay, and for a terminal among the members."""
    r = groups.join(roles(graph).select("account", "role"), "account", "left")
    any_ = lambda *names: F.max(F.when(F.col("role").isin(*names), 1).otherwise(0))
    return r.groupBy("grp").agg(((any_("COLLECTOR", "DISPERSER") + any_("RELAY") + any_("TERMINAL")) / 3.0).alias("role_evidence"))


def ring_scores(graph: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups of 3..25 members that pass the (rounded) conductance and density gates, with evidence and score, best first."""
    d = density(graph, groups).filter(F.col("size").between(*SIZES)).withColumn("density", F.round("density", 4))
    x = d.join(conductance(graph, groups).withColumn("conductance", F.round("conductance", 4)), "grp")
    x = x.filter((F.col("conductance") <= MAX_CONDUCTANCE) & (F.col("density") >= MIN_DENSITY))  # gates come before the cycle joins
    kept = groups.join(x.select("grp"), "grp", "left_semi")
    x = x.join(cycles(graph, kept), "grp").join(group_passthrough(graph, kept).select("grp", "passthrough"), "grp").join(role_evidence(graph, kept), "grp")
    one = F.lit(1.0)
    score = 0.25 * F.least(F.col("density") / 0.5, one) + 0.25 * F.greatest(F.lit(0.0), 1 - F.col("conductance")) + 0.20 * F.least(F.col("cycles") / F.col("size"), one) + 0.20 * F.col("passthrough") + 0.10 * F.col("role_evidence")
    return x.select("grp", "size", "density", "conductance", "cycles", F.round("passthrough", 4).alias("passthrough"), F.round("role_evidence", 4).alias("role_evidence"), F.round(score, 4).alias("score")).orderBy(F.desc("score"), "grp")


@dataclass
class RingReport:
    """rings: as ring_scores; members: account, grp of the flagged rings; graph_possible False, with a reason, where there are no edges."""

    graph_possible: bool
    reason: str | None
    rings: DataFrame | None = None
    members: DataFrame | None = None
    n_nodes: int = 0
    n_edges: int = 0
    n_communities_examined: int = 0
    n_rings_flagged: int = 0
    accounts_in_flagged_rings: int = 0
    role_distribution: dict | None = None


def detect_rings(edges: DataFrame, min_score: float = 0.0) -> RingReport:
    """Candidate rings from structure alone: communities and their parts, different ones once, gated, scored, best first."""
    graph = written(collapse(edges), "graph")
    if not graph.limit(1).count():
        return RingReport(False, "no edges supplied")
    groups = written(distinct_groups(candidate_groups(graph)), "groups")
    rings = written(ring_scores(graph, groups).filter(F.col("score") >= min_score), "rings")
    flagged = rings.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("a")).first()
    kinds = {r.role: r["count"] for r in roles(graph).groupBy("role").count().collect()}
    return RingReport(
        True, None, rings, written(groups.join(rings.select("grp"), "grp", "left_semi"), "ring-members"), sum(kinds.values()), graph.count(), groups.select("grp").distinct().count(), flagged.n, flagged.a, kinds
    )


def distinct_groups(groups: DataFrame) -> DataFrame:
    """groups (account, grp) without groups that have the same members as one earlier in order; members are compared by number and two sums of hashes."""
    sums = [F.sum(F.xxhash64("account", F.lit(k)).cast("decimal(38,0)")).alias(f"_h{k}") for k in (1, 2)]
    keys = groups.groupBy("grp").agg(F.count("*").alias("_n"), *sums)
    first = keys.groupBy("_n", "_h1", "_h2").agg(F.min("grp").alias("grp")).select("grp")
    return groups.join(first, "grp", "left_semi")


def ring_curve(rings: DataFrame, groups: DataFrame, truth: DataFrame, tops: tuple[int, ...] = (3, 5, 8, 10, 15, 20, 30, 50)) -> DataFrame:
    """Per k of `tops` that the rings reach: what the members of the k best rings catch of truth (account)."""
    # the best rings by a bounded sort, then numbered
    top = rings.orderBy(F.desc("score"), "grp").limit(max(tops))
    place = top.select("grp", F.row_number().over(Window.orderBy(F.desc("score"), "grp")).alias("place"))
    # an account counts from its best ring on
    best = groups.join(F.broadcast(place), "grp").groupBy("account").agg(F.min("place").alias("place"))
    best = best.join(truth.select("account").distinct().withColumn("hit", F.lit(1)), "account", "left")
    reach = place.agg(F.max("place").alias("n"))
    ks = rings.sparkSession.createDataFrame([(k,) for k in tops], "top_k_rings int").crossJoin(F.broadcast(reach)).filter("top_k_rings <= n")
    c = ks.join(best, F.col("place") <= F.col("top_k_rings")).groupBy("top_k_rings").agg(F.count("*").alias("accounts_surfaced"), F.count("hit").alias("members_found"))
    c = c.crossJoin(F.broadcast(truth.select("account").distinct().agg(F.count("*").alias("all"))))
    return c.select("top_k_rings", "accounts_surfaced", "members_found", F.round(F.col("members_found") / F.greatest("accounts_surfaced", F.lit(1)), 4).alias("precision"), F.round(F.col("members_found") / F.greatest("all", F.lit(1)), 4).alias("recall"), F.round(F.col("accounts_surfaced") / F.greatest("members_found", F.lit(1)), 1).alias("alerts_per_member"))


def laundering_truth(ledger: DataFrame, flag: str = "flag", typology: str = "typology") -> DataFrame:
    """account, typologies: accounts on either side of a flagged transfer, and of what kinds."""
    both = ledger.filter(F.col(flag) == 1).select(F.explode(F.array("src", "dst")).alias("account"), F.col(typology).alias("kind")).distinct()
    return both.groupBy("account").agg(F.array_sort(F.collect_list("kind")).alias("typologies"))


def account_scores(graph: DataFrame, seeds: DataFrame, rings: DataFrame, members: DataFrame) -> DataFrame:
    """account, graph_proximity, ring_score of every account of the graph, for a sink."""
    accounts = graph.select(F.explode(F.array("src", "dst")).alias("account")).distinct()
    near = propagate(graph, seeds).select("account", F.col("score").alias("graph_proximity"))
    out = accounts.join(near, "account", "left").join(account_ring(rings, members), "account", "left")
    return out.select("account", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("graph_proximity", "ring_score")])


def account_ring(rings: DataFrame, groups: DataFrame) -> DataFrame:
    return groups.join(rings.select("grp", "score"), "grp").groupBy("account").agg(F.max("score").alias("ring_score"))


def _links(graph: DataFrame) -> DataFrame:
    """u, v, w: every undirected link from both ends."""
    u = graph.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum("weight").cast("double").alias("w"))
    return written(u.unionByName(u.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")), "graph")


def _settled(both: DataFrame, label: DataFrame, free: int = 8) -> DataFrame:
    """account, grp: label propagation to its fixed point, where no account has a label with more weight among its neighbours.

    The first `free` rounds are synchronous, ties to the smallest label; every other round an account keeps its label if
    that is as good. After that an account moves only for strictly more weight, and of neighbours that want to move only
    the one that comes first: each round adds to the weight inside groups, so the rounds end.
    """
    k = 0
    while True:
        votes = both.join(label.select(F.col("account").alias("v"), "grp"), "v").groupBy(F.col("u").alias("account"), "grp").agg(F.round(F.sum("w"), 9).alias("w"))
        if k < free and k % 2:
            votes = votes.unionByName(label.withColumn("w", F.lit(1.0))).groupBy("account", "grp").agg(F.sum("w").alias("w"))
        best = votes.groupBy("account").agg(F.min(F.struct((-F.col("w")).alias("less"), "grp")).alias("b"))
        move = best.select("account", F.col("b.grp").alias("new"))
        if k >= free:
            own = votes.join(label, ["account", "grp"]).select("account", F.col("w").alias("own"))
            want = best.join(own, "account", "left").filter(-F.col("b.less") > F.coalesce("own", F.lit(0.0)) + 1e-8)
            want = written(want.select("account", F.col("b.grp").alias("new"), F.xxhash64("account", F.lit(k)).alias("turn")), "moves")
            if want.isEmpty():
                return label
            a, b = (want.select(F.col("account").alias(c), F.struct("turn", "account").alias(f"t{c}")) for c in "uv")
            move = want.join(both.join(a, "u").join(b, "v").filter("tv > tu").select(F.col("u").alias("account")).distinct(), "account", "left_anti").select("account", "new")
        label = written(label.join(move, "account", "left").select("account", F.coalesce("new", "grp").alias("grp")), "labels")
        k += 1


def _singles(both: DataFrame) -> DataFrame:
    return both.select(F.col("u").alias("account")).distinct().withColumn("grp", F.col("account"))


def communities(graph: DataFrame) -> DataFrame:
    """account, grp: weighted label propagation on the undirected graph, to its fixed point. Rounds are written to the shared folder."""
    both = _links(graph)
    return _settled(both, _singles(both))


def candidate_groups(graph: DataFrame) -> DataFrame:
    """account, grp ("depth:label"): communities, and of those over 25 members their parts, coarse and children both kept.

    Down to MAX_REFINE levels, all groups over the size at once. Inside a group, a link weighs w - r k_u k_v / 2m (degrees and
    total weight within the group; the resolution r doubles at each level), links of no more than 0 go, and labels
    settle anew. A part equal to its parent is not listed twice, but is split further.
    """
    both = _links(graph)
    label = _settled(both, _singles(both))
    out, inside = label.withColumn("depth", F.lit(0)), both
    for depth in range(1, MAX_REFINE + 1):
        large = label.groupBy("grp").agg(F.count("*").alias("size")).filter(F.col("size") > SIZES[1])
        members = written(label.join(large, "grp").select("account", F.col("grp").alias("parent"), "size"), "members")
        if members.isEmpty():
            break
        a, b = members.select(F.col("account").alias("u"), "parent"), members.select(F.col("account").alias("v"), "parent")
        inside = written(inside.select("u", "v", "w").join(a, "u").join(b, ["v", "parent"]), "graph")  # w stays the plain weight
        deg = inside.groupBy("u", "parent").agg(F.sum("w").alias("k"))
        total = inside.groupBy("parent").agg(F.sum("w").alias("m2"))
        x = inside.join(deg.select("u", F.col("k").alias("ku")), "u").join(deg.select(F.col("u").alias("v"), F.col("k").alias("kv")), "v").join(total, "parent")
        gain = F.col("w") - F.lit(2.0**depth) * F.col("ku") * F.col("kv") / F.col("m2")
        strong = written(x.select("u", "v", gain.alias("w")).filter("w > 1e-9"), "graph")
        label = _settled(strong, members.select("account", F.col("account").alias("grp")))
        parts = label.join(members, "account").withColumn("n", F.count("*").over(Window.partitionBy("grp")))
        out = out.unionByName(parts.filter("n < size").select("account", "grp", F.lit(depth).alias("depth")))
    return out.select("account", F.concat_ws(":", F.col("depth").cast("string"), F.col("grp").cast("string")).alias("grp"))


EDGES_SQL = "g AS (SELECT src, dst, count(*) AS weight, sum(coalesce(amount, 1)) AS amount FROM ledger WHERE src <> dst GROUP BY src, dst), u AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM g)"
ROLES_SQL = """deg AS (SELECT account, sum(i) AS ind, sum(o) AS outd, sum(ai) AS inflow, sum(ao) AS outflow FROM
  (SELECT src AS account, 0 AS i, 1 AS o, 0 AS ai, amount AS ao FROM g UNION ALL SELECT dst, 1, 0, amount, 0 FROM g) GROUP BY account),
roles AS (SELECT account, CAST(ind AS BIGINT) AS ind, CAST(outd AS BIGINT) AS outd, inflow, outflow, CASE WHEN ind = 0 AND outd = 0 THEN 'ISOLATED' WHEN ind = 0 THEN 'SOURCE' WHEN outd = 0 THEN 'TERMINAL'
  WHEN coalesce(abs(inflow - outflow) / nullif(inflow + outflow, 0), 1) < 0.15 THEN 'RELAY' WHEN ind >= 3 * outd THEN 'COLLECTOR' WHEN outd >= 3 * ind THEN 'DISPERSER' ELSE 'ORDINARY' END AS role FROM deg)"""
HOPS_SQL = """bi AS (SELECT u, v FROM u UNION ALL SELECT v, u FROM u),
h0 AS (SELECT account FROM seeds),
h1 AS (SELECT DISTINCT v AS account FROM bi JOIN h0 ON u = account WHERE v NOT IN (SELECT account FROM h0)),
h2 AS (SELECT DISTINCT v AS account FROM bi JOIN h1 ON u = account WHERE v NOT IN (SELECT account FROM h0 UNION SELECT account FROM h1)),
h3 AS (SELECT DISTINCT v AS account FROM bi JOIN h2 ON u = account WHERE v NOT IN (SELECT account FROM h0 UNION SELECT account FROM h1 UNION SELECT account FROM h2)),
hops AS (SELECT account, 0 AS hop, 1.0 AS score FROM h0 UNION ALL SELECT account, 1, 0.85 FROM h1 UNION ALL SELECT account, 2, 0.70 FROM h2 UNION ALL SELECT account, 3, 0.55 FROM h3)"""
GROUP_SQL = """ins AS (SELECT a.grp, g.src, g.dst FROM g JOIN groups a ON g.src = a.account JOIN groups b ON g.dst = b.account WHERE a.grp = b.grp),
dens AS (SELECT s.grp, s.size, coalesce(i.n, 0) AS internal, coalesce(i.n, 0) / nullif(CAST(s.size * (s.size - 1) AS DOUBLE), 0) AS density FROM (SELECT grp, count(*) AS size FROM groups GROUP BY grp) s LEFT JOIN (SELECT grp, count(*) AS n FROM ins GROUP BY grp) i USING (grp)),
udeg AS (SELECT account, count(*) AS degree FROM (SELECT u AS account FROM u UNION ALL SELECT v FROM u) GROUP BY account),
vol AS (SELECT grp, sum(coalesce(degree, 0)) AS vol FROM groups LEFT JOIN udeg USING (account) GROUP BY grp),
inn AS (SELECT a.grp, count(*) AS n FROM u JOIN groups a ON u.u = a.account JOIN groups b ON u.v = b.account WHERE a.grp = b.grp GROUP BY a.grp),
cond AS (SELECT vol.grp, CASE WHEN least(vol, t - vol) <= 0 THEN 1.0 ELSE greatest(vol - 2 * coalesce(n, 0), 0) / CAST(least(vol, t - vol) AS DOUBLE) END AS conductance FROM vol LEFT JOIN inn USING (grp) CROSS JOIN (SELECT 2 * count(*) AS t FROM u)),
sized AS (SELECT grp FROM dens WHERE size BETWEEN 3 AND 25),
e AS (SELECT * FROM ins WHERE grp IN (SELECT grp FROM sized)),
cyc AS (
  SELECT a.grp, count(*) AS n FROM e a JOIN e b ON a.grp = b.grp AND a.dst = b.src WHERE b.dst = a.src AND a.src < a.dst GROUP BY a.grp
  UNION ALL SELECT a.grp, count(*) FROM e a JOIN e b ON a.grp = b.grp AND a.dst = b.src JOIN e c ON c.grp = a.grp AND c.src = b.dst WHERE c.dst = a.src AND a.src < a.dst AND a.src < b.dst AND b.dst <> a.dst GROUP BY a.grp
  UNION ALL SELECT a.grp, count(*) FROM e a JOIN e b ON a.grp = b.grp AND a.dst = b.src JOIN e c ON c.grp = a.grp AND c.src = b.dst JOIN e d ON d.grp = a.grp AND d.src = c.dst
    WHERE d.dst = a.src AND a.src < a.dst AND a.src < b.dst AND a.src < c.dst AND b.dst <> a.dst AND c.dst NOT IN (a.dst, b.dst) GROUP BY a.grp
  UNION ALL SELECT a.grp, count(*) FROM e a JOIN e b ON a.grp = b.grp AND a.dst = b.src JOIN e c ON c.grp = a.grp AND c.src = b.dst JOIN e d ON d.grp = a.grp AND d.src = c.dst JOIN e f ON f.grp = a.grp AND f.src = d.dst
    WHERE f.dst = a.src AND a.src < a.dst AND a.src < b.dst AND a.src < c.dst AND a.src < d.dst AND b.dst <> a.dst AND c.dst NOT IN (a.dst, b.dst) AND d.dst NOT IN (a.dst, b.dst, c.dst) GROUP BY a.grp),
cycles AS (SELECT grp, CAST(coalesce(sum(n), 0) AS BIGINT) AS cycles FROM sized LEFT JOIN cyc USING (grp) GROUP BY grp),
bound AS (SELECT a.grp AS g1, b.grp AS g2, amount FROM g LEFT JOIN groups a ON g.src = a.account LEFT JOIN groups b ON g.dst = b.account WHERE a.grp IS NULL OR b.grp IS NULL OR a.grp <> b.grp),
gpass AS (SELECT grp, coalesce(i, 0) AS inflow, coalesce(o, 0) AS outflow, least(coalesce(coalesce(o, 0) / nullif(coalesce(i, 0), 0), 0), 1) AS passthrough FROM (SELECT DISTINCT grp FROM groups)
  LEFT JOIN (SELECT g2 AS grp, sum(amount) AS i FROM bound GROUP BY 1) USING (grp) LEFT JOIN (SELECT g1 AS grp, sum(amount) AS o FROM bound GROUP BY 1) USING (grp)),
grole AS (SELECT grp, (max(CASE WHEN role IN ('COLLECTOR', 'DISPERSER') THEN 1 ELSE 0 END) + max(CASE WHEN role = 'RELAY' THEN 1 ELSE 0 END) + max(CASE WHEN role = 'TERMINAL' THEN 1 ELSE 0 END)) / 3.0 AS role_evidence FROM groups LEFT JOIN roles USING (account) GROUP BY grp),
rings AS (SELECT grp, size, round(density, 4) AS density, round(conductance, 4) AS conductance, cycles, round(passthrough, 4) AS passthrough, round(role_evidence, 4) AS role_evidence,
  round(0.25 * least(round(density, 4) / 0.5, 1) + 0.25 * greatest(0, 1 - round(conductance, 4)) + 0.20 * least(cycles / CAST(size AS DOUBLE), 1) + 0.20 * passthrough + 0.10 * role_evidence, 4) AS score
  FROM dens JOIN cond USING (grp) JOIN cycles USING (grp) JOIN gpass USING (grp) JOIN grole USING (grp) WHERE round(conductance, 4) <= 0.60 AND round(density, 4) >= 0.15)"""
