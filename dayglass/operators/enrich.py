"""Joins of events with per-user attributes.

No broadcast is forced: Spark broadcasts a side only when its measured size is
below the session's limit. Above it the join shuffles, and the adaptive skew
join splits a user that holds a large share of the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from dayglass import config


def join_attributes(events: DataFrame, attributes: DataFrame, on: str = "user_id") -> DataFrame:
    """Left join; ``attributes`` has one row per key."""
    return events.join(attributes, on, "left")


def join_traits(events: DataFrame, traits: DataFrame, on: str = "user_id") -> DataFrame:
    """Left join of the trait columns that exist."""
    present = [c for c in config.TRAITS if c in traits.columns]
    return events.join(traits.select(on, *present), on, "left")


def join_labels(features: DataFrame, labels: DataFrame, on: list[str], label: str) -> DataFrame:
    """Left join of labels, null read as 0."""
    return features.join(labels.select(*on, label), on, "left").na.fill(0, [label])
