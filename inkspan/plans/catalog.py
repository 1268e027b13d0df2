"""All registered queries, gathered from the plan modules."""

from __future__ import annotations

from inkspan.plans import complete_plans, library_plans, light_plans, mask_plans, outline_plans, pixel_plans, recognition_plans, resample_plans, shape_plans, state_plans, surface_plans, text_plans, vanishing_plans  # noqa: F401
from inkspan.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
