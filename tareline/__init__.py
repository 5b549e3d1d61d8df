"""Spark jobs that turn reported product quantities into raw-equivalent ones."""

from tareline.session import materialise, recommended_conf

__all__ = ["materialise", "recommended_conf"]
