"""Role categories and other label rules on titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave import rules
from jobweave.functions.common import first_rule, lookup, text


def role_category(title="job_title", roles=None, other=rules.DASHBOARD_ROLE_OTHER) -> Column:
    roles = rules.DASHBOARD_ROLES if roles is None else roles
    return first_rule(F.lower(text(title)), roles.items(), other)


def chart_role(title="job_title") -> Column:
    return role_category(title, rules.CHART_ROLES, rules.CHART_ROLE_OTHER)


def coarse_role(title="job_title") -> Column:
    return role_category(title, rules.COARSE_ROLES, rules.COARSE_ROLE_OTHER)


def level_number(c="experience_level_inferred") -> Column:
    """intern 0 ... lead 5, NULL for anything else."""
    order = {name: i for i, name in enumerate(rules.LEVEL_ORDER)}
    return lookup(text(c), order, F.lit(None).cast("int"))


def level_rank(c="experience_level_inferred", order=None) -> Column:
    """Position in the canonical order; unknown levels come last."""
    order = rules.LEVEL_ORDER if order is None else order
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), text(c))
    return F.when(pos == 0, len(order) + 1).otherwise(pos)


def work_mode(c) -> Column:
    return first_rule(F.lower(text(c)), rules.WORK_MODES, rules.WORK_MODE_DEFAULT)
