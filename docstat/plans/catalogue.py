"""All queries of the engine and their DuckDB SQL."""

from docstat.plans import line_plans, registry_plans, stage_plans

QUERIES = line_plans.QUERIES | registry_plans.QUERIES | stage_plans.QUERIES
ORACLES = line_plans.ORACLES | registry_plans.ORACLES | stage_plans.ORACLES
