"""All registered queries: importing a plan module registers its queries."""

from __future__ import annotations

from marginalia.plans import (  # noqa: F401
    calendar_plans,
    insight_plans,
    note_plans,
    pipeline_plans,
    registry,
    retrieval_plans,
    routing_plans,
    stream_plans,
    task_plans,
    usage_plans,
)


def queries():
    return registry.all_queries()


def oracle_sql():
    return registry.all_oracles()
