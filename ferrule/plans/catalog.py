"""All core registries."""

from __future__ import annotations

from ferrule.plans import extraction, glossary, graph, relations, retrieval, scalars, snapshots, statistics, streams, structure, texts, usage
from ferrule.plans.registry import Registry


def registries() -> list[Registry]:
    return [structure.R, statistics.R, snapshots.R, usage.R, retrieval.R, scalars.R, graph.R, extraction.R, streams.R, glossary.R, relations.R, texts.R]
