"""Component scoring queries (F, E16-E21, E29, E30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.catalog import bindings as B
from codeloom.catalog.registry import binding, query
from codeloom.functions import scoring as S
from codeloom.operators import metrics as M

c = F.col

binding(
    "comp1",
    "SELECT *, CAST(CASE type WHEN 'corba_interface' THEN 15 + 2 * n_methods + CASE WHEN n_inherit > 0 THEN 10 ELSE 0 END "
    "WHEN 'class' THEN 5 + n_methods + complexity WHEN 'function' THEN complexity ELSE 0 END + 3 * n_patterns + 2 * n_logic AS INTEGER) AS points "
    "FROM ent WHERE type IN ('class', 'function', 'corba_interface', 'corba_struct')",
)
binding(
    "comp2",
    "SELECT *, CASE WHEN points < 10 THEN 'Low' WHEN points < 25 THEN 'Medium' WHEN points < 50 THEN 'High' ELSE 'Very High' END AS level FROM comp1",
)
binding(
    "comp3",
    "SELECT *, CASE level WHEN 'Low' THEN 8 WHEN 'Medium' THEN 24 WHEN 'High' THEN 56 ELSE 120 END AS base, "
    "CASE level WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END + CASE WHEN type = 'corba_interface' THEN 2 ELSE 0 END "
    "+ CASE WHEN n_inherit > 0 OR n_bases > 0 THEN 1 ELSE 0 END + CASE WHEN n_logic > 0 THEN 1 ELSE 0 END AS risk_points, "
    "CAST(least(99, n_inherit + n_bases + n_calls) AS INTEGER) AS n_deps, "
    "CASE WHEN type = 'corba_interface' THEN 'Convert to REST API with OpenAPI specification' WHEN type = 'corba_struct' THEN 'Convert to JSON schema or DTO class' "
    "WHEN type = 'class' AND pat = 0 THEN 'Replace with dependency injection' WHEN type = 'class' AND pat = 1 THEN 'Modernize to use IoC container' "
    "WHEN type = 'class' AND pat = 2 THEN 'Refactor to modern design patterns' ELSE 'Refactor with modern best practices' END AS approach, "
    "CASE type WHEN 'corba_interface' THEN 'CORBA Interface' WHEN 'corba_struct' THEN 'Data Structure' WHEN 'class' THEN 'Service Class' ELSE 'Function' END AS component_type "
    "FROM comp2",
)
binding(
    "comp4",
    "SELECT *, CAST(CASE type WHEN 'corba_interface' THEN base * 1.5 WHEN 'class' THEN base + 2.0 * n_methods ELSE base END AS DOUBLE) AS effort_hours, "
    "CASE WHEN risk_points <= 2 THEN 'Low' WHEN risk_points <= 4 THEN 'Medium' WHEN risk_points <= 6 THEN 'High' ELSE 'Critical' END AS risk_level FROM comp3",
)
binding(
    "comp5",
    "SELECT *, CAST(CASE risk_level WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END + "
    "CASE level WHEN 'Very High' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END + CASE WHEN n_deps > 10 THEN 1.0 WHEN n_deps > 5 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS priority_points, "
    "CASE WHEN effort_hours < 40 THEN CAST(floor(effort_hours) AS BIGINT) || ' hours' ELSE CAST(floor(effort_hours / 8) AS BIGINT) || ' days' END AS effort_text, "
    "CAST(CASE WHEN effort_hours < 40 THEN floor(effort_hours) ELSE floor(effort_hours / 8) * 8 END AS BIGINT) AS billed_hours FROM comp4",
)
binding(
    "comp",
    "SELECT *, CASE WHEN priority_points >= 6 THEN 1 WHEN priority_points >= 5 THEN 2 WHEN priority_points >= 3 THEN 3 WHEN priority_points >= 2 THEN 4 ELSE 5 END AS priority FROM comp5",
)


def components(spark, d):
    return S.score_components(B.entities(spark, d))


def _component_query(key, *columns):
    @query(key, f"SELECT k, {', '.join(columns)} FROM comp")
    def run(spark, d):
        return components(spark, d).select("k", *columns)

    return run


_component_query("F1", "points", "level")
_component_query("F2", "effort_hours", "effort_text")
_component_query("F3", "risk_level")
_component_query("F4", "approach")
_component_query("F5", "n_deps")
_component_query("F6", "priority_points", "priority")
_component_query("F18", "name", "component_type", "level", "n_deps", "risk_level", "effort_hours", "approach", "priority")


@query("F7", "SELECT k, CASE type WHEN 'corba_interface' THEN 'CORBA Interface' WHEN 'corba_struct' THEN 'Data Structure' WHEN 'class' THEN 'Service Class' "
             "WHEN 'function' THEN 'Function' WHEN 'interface' THEN 'Interface' ELSE 'Component' END AS component_type FROM ent")
def component_types(spark, d):
    return B.entities(spark, d).select("k", S.component_type(c("type")).alias("component_type"))


# ---- numeric model -----------------------------------------------------------

binding(
    "ecomp1",
    "SELECT *, round(least(complexity / 20.0::DOUBLE, 5.0) + least(n_deps_list / 10.0::DOUBLE, 3.0) + least(n_rules / 5.0::DOUBLE, 2.0) + "
    "CASE WHEN regexp_matches(file_path, 'api|service|client|integration|external') THEN 2.0 ELSE 0.0 END, 6) AS raw_score, "
    "CASE WHEN n_rules >= 5 THEN 3 WHEN n_rules >= 2 THEN 2 WHEN n_rules >= 1 THEN 1 ELSE 0 END + "
    "CASE WHEN regexp_matches(file_path, 'payment|order|account|security|auth') THEN 2 WHEN regexp_matches(file_path, 'service|controller|manager') THEN 1 ELSE 0 END AS crit_points, "
    "CASE type WHEN 'class' THEN 40 WHEN 'interface' THEN 20 WHEN 'function' THEN 16 ELSE 20 END AS base FROM ent",
)
binding(
    "ecomp2",
    "SELECT *, round_even(raw_score, 1) AS complexity_score, "
    "CASE WHEN crit_points >= 5 THEN 'critical' WHEN crit_points >= 3 THEN 'high' WHEN crit_points >= 1 THEN 'medium' ELSE 'low' END AS criticality, "
    "CAST(floor(base * (1 + raw_score / 10) * (1 + n_deps_list * 0.1::DOUBLE) + 1e-9) AS INTEGER) AS effort_hours, "
    "CASE WHEN raw_score <= 3 THEN 'Direct migration with minimal refactoring' WHEN raw_score <= 6 THEN 'Refactor during migration for better maintainability' "
    "WHEN raw_score <= 8 THEN 'Significant refactoring required, consider redesign' ELSE 'Complex migration - consider complete rewrite' END AS approach, "
    "list_filter([CASE WHEN raw_score > 7 THEN 'High complexity may require extended testing' END, CASE WHEN n_deps_list > 10 THEN 'Many dependencies may cause integration issues' END, "
    "CASE WHEN regexp_matches(file_path, 'legacy|deprecated|old') THEN 'Legacy code patterns may be difficult to modernize' END], lambda x: x IS NOT NULL) AS found FROM ecomp1",
)
binding(
    "ecomp",
    "SELECT *, CASE WHEN len(found) > 0 THEN found ELSE ['Standard migration risks apply'] END AS risks, "
    "CASE criticality WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS criticality_rank FROM ecomp2",
)


def scored(spark, d):
    return S.score_numeric(B.entities(spark, d))


def _numeric_query(key, *columns):
    @query(key, f"SELECT k, {', '.join(columns)} FROM ecomp")
    def run(spark, d):
        return scored(spark, d).select("k", *columns)

    return run


_numeric_query("F11", "raw_score", "complexity_score")
_numeric_query("F12", "criticality")
_numeric_query("F13", "effort_hours")
_numeric_query("F14", "approach")


@query("F15", "SELECT k, array_to_string(risks, '; ') AS risks FROM ecomp")
def risks(spark, d):
    return scored(spark, d).select("k", F.array_join("risks", "; ").alias("risks"))


# ---- summaries --------------------------------------------------------------------

SUMMARY = (
    "SELECT *, CAST(greatest(0, least(100, 50 + CASE WHEN total_components > 0 THEN floor((n_low + n_medium * 0.7::DOUBLE + n_high * 0.3::DOUBLE) / total_components * 30 + 1e-9) ELSE 0 END "
    "- least(30, critical_components * 5))) AS INTEGER) AS readiness, CAST(floor(floor(hours * 1.2::DOUBLE + 1e-9) / 8) AS BIGINT) AS effort_days FROM "
    "(SELECT count(*) AS total_components, count(*) FILTER (WHERE risk_level = 'Critical') AS critical_components, "
    "count(*) FILTER (WHERE risk_level IN ('High', 'Critical')) AS high_risk_components, count(*) FILTER (WHERE level IN ('Low', 'Medium')) AS modernization_opportunities, "
    "count(*) FILTER (WHERE level = 'Low') AS n_low, count(*) FILTER (WHERE level = 'Medium') AS n_medium, count(*) FILTER (WHERE level IN ('High', 'Very High')) AS n_high, "
    "coalesce(sum(billed_hours), 0) AS hours FROM comp)"
)
binding("summary", SUMMARY)


def summary(spark, d):
    return M.migration_summary(components(spark, d))


@query("E16", "SELECT total_components, critical_components, high_risk_components, modernization_opportunities FROM summary")
def summary_counts(spark, d):
    return summary(spark, d).select(
        "total_components", "critical_components", "high_risk_components", "modernization_opportunities"
    )


@query("E17", "SELECT readiness FROM summary")
def readiness(spark, d):
    return summary(spark, d).select("readiness")


@query("E18", "SELECT effort_days FROM summary")
def total_effort(spark, d):
    return summary(spark, d).select("effort_days")


@query("F10", "SELECT CASE WHEN readiness >= 80 THEN 'Direct Migration - System is well-suited for modernization' "
              "WHEN readiness >= 60 THEN 'Phased Migration - Migrate in stages starting with low-risk components' "
              "WHEN readiness >= 40 THEN 'Hybrid Approach - Maintain legacy system while building new components' "
              "ELSE 'Strangler Fig Pattern - Gradually replace legacy system piece by piece' END AS recommended_approach, "
              "CASE WHEN b <= 30 THEN '1 month' WHEN b <= 90 THEN '2-3 months' WHEN b <= 180 THEN '4-6 months' WHEN b <= 365 THEN '6-12 months' "
              "ELSE '12+ months (consider breaking into smaller projects)' END AS timeline, "
              "format('${:,} (', effort_days * 1000) || CASE WHEN effort_days * 1000 < 50000 THEN 'Small' WHEN effort_days * 1000 < 250000 THEN 'Medium' "
              "WHEN effort_days * 1000 < 1000000 THEN 'Large' ELSE 'Enterprise' END || ' project)' AS investment, "
              "CASE WHEN readiness >= 70 THEN 'Low disruption expected - system is migration-ready' WHEN readiness >= 50 THEN 'Moderate disruption - requires careful planning' "
              "ELSE 'High disruption risk - consider phased approach' END AS business_impact FROM (SELECT *, effort_days + high_risk_components * 5 AS b FROM summary)")
def overall(spark, d):
    return summary(spark, d).select("recommended_approach", "timeline", "investment", "business_impact")


@query("E19", "SELECT lower(risk_level) AS risk, name, component_type AS type, level AS complexity, effort_text AS effort, n_deps AS dependencies, approach FROM comp")
def risk_matrix(spark, d):
    return M.risk_matrix(components(spark, d))


@query("E20", "SELECT component_type, count(*) AS components, CAST(sum(billed_hours) AS BIGINT) AS total_effort, count(*) FILTER (WHERE level = 'Low') AS n_low, "
              "count(*) FILTER (WHERE level = 'Medium') AS n_medium, count(*) FILTER (WHERE level = 'High') AS n_high, count(*) FILTER (WHERE level = 'Very High') AS n_very_high, "
              "CAST(floor(sum(billed_hours) / count(*)) AS BIGINT) AS avg_effort FROM comp GROUP BY 1")
def effort_breakdown(spark, d):
    return M.effort_breakdown(components(spark, d))


@query("E21", "SELECT component_type, n, round(n / sum(n) OVER () * 100, 1) AS pct FROM (SELECT component_type, count(*) AS n FROM comp GROUP BY 1)")
def technology_breakdown(spark, d):
    return M.technology_breakdown(components(spark, d))


@query("E21_insights", "SELECT insight FROM (SELECT CASE WHEN readiness >= 70 THEN 'System shows good readiness for modernization' WHEN readiness < 40 THEN 'System requires significant preparation before migration' END AS insight FROM summary "
                       "UNION ALL SELECT CASE WHEN critical_components > 0 THEN critical_components || ' critical components require immediate attention' END FROM summary) WHERE insight IS NOT NULL")
def insights(spark, d):
    return M.key_insights(summary(spark, d))


@query("E29", "SELECT e AS total_effort, m AS months, greatest(2, least(8, e // (m * 160))) AS team_size FROM "
              "(SELECT e, greatest(6, e // 160) AS m FROM (SELECT CAST(sum(effort_hours) AS BIGINT) AS e FROM ecomp))")
def strategy(spark, d):
    return M.strategy_totals(scored(spark, d))


@query("E30", "SELECT count(*) AS n_components, round(avg(complexity_score), 4) AS avg_complexity, CAST(sum(effort_hours) AS BIGINT) AS total_effort, "
              + ", ".join(f"count(*) FILTER (WHERE criticality = '{x}') AS n_{x}" for x in ("critical", "high", "medium", "low")) + " FROM ecomp")
def statistics(spark, d):
    return M.component_statistics(scored(spark, d))
