"""The drift policy on a live stream of measurements: each source keeps its streaks in state."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators.monitor import BREACHES, MIN_REVIEWED, PRECISION_TOL, PSI_MATERIAL, PSI_SEVERE, SCORE_PSI
from ledgerloom.shipping import ship

CONDITIONS = ("severe", "fell", "material", "shift")
ACTIONS = ("HALT_AUTOMATION", "REFIT_THRESHOLDS", "RETRAIN", "RECALIBRATE")


def breaches(weighted_psi, score_psi, precision, reviewed, target: float) -> tuple[bool, ...]:
    """Which of CONDITIONS hold in one measurement; what was not measured breaches nothing."""
    known = lambda x: x is not None and x == x
    fell = known(reviewed) and reviewed >= MIN_REVIEWED and known(precision) and precision < target * (1 - PRECISION_TOL)
    return (known(weighted_psi) and weighted_psi >= PSI_SEVERE, fell, known(weighted_psi) and weighted_psi >= PSI_MATERIAL, known(score_psi) and score_psi >= SCORE_PSI)


def live_policy(measurements: DataFrame, target: float) -> DataFrame:
    """measurements (a stream): source, batch, weighted_psi, score_psi, precision, reviewed -> source, batch, action, signoff.

    As monitor.policy: a condition acts once it holds in BREACHES batches of its source in a row, of several the most severe
    decides. Within a micro-batch a source's measurements are taken in the order of batch; state is four numbers a source.
    """

    ship(measurements.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streaks = list(state.get) if state.exists else [0] * len(CONDITIONS)
        out = []
        for r in pd.concat(list(frames)).sort_values("batch").itertuples(index=False):
            held = breaches(r.weighted_psi, r.score_psi, r.precision, r.reviewed, target)
            streaks = [s + 1 if h else 0 for s, h in zip(streaks, held, strict=True)]
            action = next((a for a, s in zip(ACTIONS, streaks, strict=True) if s >= BREACHES), "MONITOR")
            out.append((key[0], r.batch, action, streaks[0] >= BREACHES))
        state.update(tuple(streaks))
        yield pd.DataFrame(out, columns=["source", "batch", "action", "signoff"])

    rows = measurements.select("source", "batch", "weighted_psi", "score_psi", "precision", "reviewed")
    return rows.groupBy("source").applyInPandasWithState(run, "source string, batch long, action string, signoff boolean", ", ".join(f"{c} long" for c in CONDITIONS), "append", GroupStateTimeout.NoTimeout)
