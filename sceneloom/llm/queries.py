"""The queries of this subpackage, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import cross_split, grouped_split, leaks, packing, shared_spans, splitting, truncation

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, root: f(table(spark, root, name))


def _on_leaks(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, root: f(table(spark, root, "documents"), table(spark, root, "eval_scenes"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on("sft_pairs", cross_split.found_pairs),
        "p1_report": _on("sft_pairs", cross_split.report),
        "p1_links": _on("sft_pairs", cross_split.links),
        "p1_classes": _on("sft_pairs", cross_split.classes),
        "p1_record_overlaps": _on("sft_pairs", cross_split.record_overlaps),
        "p2_found": _on("master_segments", grouped_split.torn),
        "p2_assign": _on("master_segments", grouped_split.assign),
        "p2_balance": _on("master_segments", grouped_split.balance),
        "p2_labels": _on("master_segments", grouped_split.label_balance),
        "p2_check": _on("master_segments", grouped_split.check),
        "p3_found": _on("sft_pairs", shared_spans.found_pairs),
        "p3_groups": _on("sft_pairs", shared_spans.groups),
        "p3_coverage": _on("sft_pairs", shared_spans.coverage),
        "p4_found": _on("master_segments", splitting.found),
        "p4_pieces": _on("master_segments", splitting.pieces),
        "p4_check": _on("master_segments", splitting.check),
        "p5_pack": _on("documents", packing.pack),
        "p5_fill": _on("documents", packing.fill_report),
        "p5_check": _on("documents", packing.check),
        "p6_found": _on_leaks(leaks.found),
        "p6_proximity": _on_leaks(leaks.proximity),
        "p7_found": _on("documents", truncation.found),
        "p7_rates": _on("documents", truncation.rates),
        "p7_limits": _on("documents", truncation.limits),
        "p7_reasons": _on("documents", truncation.reasons),
    }


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return SQL
