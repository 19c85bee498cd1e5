"""All registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from outlake.plans.depth import DEPTH
from outlake.plans.entities import ENTITIES
from outlake.plans.merges import MERGES
from outlake.plans.more import MORE
from outlake.plans.people import PEOPLE
from outlake.plans.reports import REPORTS
from outlake.plans.research import RESEARCH
from outlake.plans.states import STATES
from outlake.plans.views import with_views

GROUPS = (REPORTS, ENTITIES, MORE, PEOPLE, RESEARCH, STATES, MERGES, DEPTH)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for group in GROUPS for name, (query, _) in group.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for group in GROUPS for name, (_, sql) in group.items() if sql}
