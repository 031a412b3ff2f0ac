"""Loomwright: corpus, graph, retrieval and workload analytics as Spark jobs."""

from loomwright.session import configure, cut_lineage

__all__ = ["configure", "cut_lineage"]
