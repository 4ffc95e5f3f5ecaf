"""One score from behaviour, motifs and structure: the 28 ledger columns with 10 network columns, and a fitted or rank-based scorer."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import graph, ledger, motifs
from ledgerloom.sources.io import written

#: The network columns.
MOTIF_COLUMNS = ("motif_score", "motif_fan_out", "motif_fan_in", "motif_gather_scatter", "motif_chain")
RING_COLUMNS = ("ring_score", "role_relay", "role_collector", "role_disperser", "role_terminal")


def network(transfers: DataFrame, rings: bool = True) -> DataFrame:
    """account_id with the network columns (0 where there is no evidence); without ring_score if not `rings`."""
    found = motifs.detect(transfers)
    flag = lambda c, value, name: F.max((F.col(c) == value).cast("double")).alias(f"{name}_{value.lower()}")
    kinds = found["by_motif"].groupBy("account").agg(*[flag("motif", m, "motif") for m in ("FAN_OUT", "FAN_IN", "GATHER_SCATTER", "CHAIN")])
    g = written(graph.collapse(transfers), "graph")
    parts = graph.roles(g).groupBy("account").agg(*[flag("role", r, "role") for r in ("RELAY", "COLLECTOR", "DISPERSER", "TERMINAL")])
    out = found["evidence"].select("account", F.col("score").alias("motif_score")).join(kinds, "account", "full").join(parts, "account", "full")
    if rings:
        report = graph.detect_rings(transfers)
        if report.graph_possible:
            out = out.join(graph.account_ring(report.rings, report.members), "account", "left")
        else:
            out = out.withColumn("ring_score", F.lit(0.0))
    names = [c for c in MOTIF_COLUMNS + RING_COLUMNS if rings or c != "ring_score"]
    return out.select(F.col("account").alias("account_id"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


def build(transfers: DataFrame, with_network: bool = True) -> DataFrame:
    """The behavioural columns of every account, with the network columns if asked for."""
    transfers = written(transfers, "ledger")
    f = ledger.features(transfers)
    return f.join(network(transfers), "account_id", "left").fillna(0.0) if with_network else f


class UnifiedScorer:
    """fit() makes it supervised; before that predict() is the label-free blend of ranks. mode says which."""

    def __init__(self, trees: int | None = None):
        from ledgerloom.operators import learn

        self.mode, self.columns, self.model, self.trees = "unfitted", [], None, trees or learn.TREES

    def fit(self, features: DataFrame, target: str, key: str = "account_id") -> "UnifiedScorer":
        from ledgerloom.operators import learn

        self.columns = [c for c in features.columns if c not in (key, target)]
        self.model = learn.Ensemble(self.columns, self.trees).fit(features, key, target)
        self.mode = "supervised"
        return self

    def predict(self, features: DataFrame, key: str = "account_id") -> DataFrame:
        """account_id, is_mule."""
        if self.model is None:
            return ledger.rank_blend(features)
        return self.model.predict(features, key).select(F.col(key).alias("account_id"), F.col("p").alias("is_mule"))
