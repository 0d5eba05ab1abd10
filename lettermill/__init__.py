"""Labelled-text analytics as Spark DataFrame operators."""

from lettermill.domain import Domain

__all__ = ["Domain"]
