"""Queries of fitted models on the account matrix; results are checked by invariants, not SQL."""

from pyspark.sql import functions as F

from ledgerloom.operators import learn as H
from ledgerloom.plans.registry import query
from ledgerloom.sources.views import acct_matrix

NAMES = ["TOT_TXNAMT_L7D", "TOT_TXNS_L7D", "AVG_BAL_7DAYS", "TOT_TXNAMT_CR_L31D", "TOT_TXNAMT_DB_L31D", "COUNT_ALERTS", "MAX_BAL_31DAYS", "VIEW_AMT_L7D"]


def _rows(spark, d):
    return acct_matrix(spark, d).select(F.col("user_id").alias("id"), "y", *NAMES)


@query()
def ml_gbt_scores(spark, d):
    return H.gbt_scores(_rows(spark, d), NAMES, "id")


@query()
def ml_stack_oof(spark, d):
    return H.out_of_fold(_rows(spark, d), NAMES)


@query()
def ml_isolation_scores(spark, d):
    rows = _rows(spark, d)
    return H.IsolationForest().fit(rows, NAMES, "id").transform(rows, "id")


@query()
def ml_feature_gain(spark, d):
    return H.feature_gain(_rows(spark, d), NAMES)


@query()
def ml_attributions(spark, d):
    return H.attributions(_rows(spark, d), NAMES, "id")


@query()
def ml_missingness_audit(spark, d):
    return H.missingness_audit(_rows(spark, d), NAMES, "id")


@query()
def ml_degradation(spark, d):
    return H.degradation(_rows(spark, d), NAMES, "id")
