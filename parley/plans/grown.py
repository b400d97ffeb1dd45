"""Queries over ratings whose conversations grow in number with the table, with their SQL."""

from __future__ import annotations

from parley.operators import agreement, consensus
from parley.plans.agreement import LINKED, REPORT
from parley.plans.catalog import _labels
from parley.registry import register
from parley.sources.tables import ORDER_RATINGS, order_ratings

register("order_labels", lambda s, d: consensus.consensus_labels(order_ratings(s, d)), ORDER_RATINGS + _labels("ratings", 1.0))
register("order_outliers", lambda s, d: agreement.outlier_report(order_ratings(s, d)), ORDER_RATINGS + f"SELECT * FROM {REPORT}")
register("order_final_labels", lambda s, d: agreement.final_labels(order_ratings(s, d)), ORDER_RATINGS + _labels(LINKED, 0.5))
