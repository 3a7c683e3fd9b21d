"""Migration scoring: one set of columns per component, no UDFs.

Expected columns: ``type, name, file_path, complexity, methods, base_classes,
inheritance, design_patterns, business_logic_patterns, function_calls`` and,
for the numeric model, ``dependencies`` and ``n_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.classify import ladder
from codeloom.functions.paths import lookup
from codeloom.functions.text import contains_any, present

# Scored kinds and the component type each becomes.
COMPONENT_TYPES = {
    "corba_interface": "CORBA Interface",
    "corba_struct": "Data Structure",
    "corba_enum": "Data Type",
    "class": "Service Class",
    "function": "Function",
    "interface": "Interface",
    "struts_action": "Web Action",
}
SCORED_KINDS = ("class", "function", "corba_interface", "corba_struct")

# Hours by complexity level, and by entity kind.
LEVEL_HOURS = {"Low": 8, "Medium": 24, "High": 56, "Very High": 120}
KIND_HOURS = {"class": 40, "interface": 20, "function": 16, "method": 12, "module": 60}

# Points for a level when it feeds another score.
RISK_OF_LEVEL = {"Low": 1, "Medium": 2, "High": 3, "Very High": 4}
PRIORITY_OF_RISK = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
PRIORITY_OF_LEVEL = {"Very High": 3, "High": 2, "Medium": 1, "Low": 0}
CRITICALITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}

# Path words that change a numeric score.
INTEGRATION_WORDS = ("api", "service", "client", "integration", "external")
CRITICAL_WORDS = ("payment", "order", "account", "security", "auth")
IMPORTANT_WORDS = ("service", "controller", "manager")
LEGACY_WORDS = ("legacy", "deprecated", "old")

# Upper bounds of the levels and lower bounds of the priorities;
# the last name applies beyond them.
LEVELS = ((10, "Low"), (25, "Medium"), (50, "High"))
TOP_LEVEL = "Very High"
RISKS = ((2, "Low"), (4, "Medium"), (6, "High"))
TOP_RISK = "Critical"
PRIORITIES = ((6, 1), (5, 2), (3, 3), (2, 4))
LAST_PRIORITY = 5
CRITICALITIES = ((5, "critical"), (3, "high"), (1, "medium"))
# (direct callers, affected nodes) up to which a risk applies
IMPACT_RISKS = ((2, 5, "Low"), (5, 15, "Medium"), (10, 30, "High"))

# Rework by kind of component, and for classes by pattern.
REWORK_INTERFACE = "Convert to REST API with OpenAPI specification"
REWORK_STRUCT = "Convert to JSON schema or DTO class"
REWORK_SINGLETON = "Replace with dependency injection"
REWORK_FACTORY = "Modernize to use IoC container"
REWORK_PATTERN = "Refactor to modern design patterns"
REWORK_OTHER = "Refactor with modern best practices"

# Approach by numeric complexity, and the risks that go with it.
NUMERIC_APPROACHES = (
    (3.0, "Direct migration with minimal refactoring"),
    (6.0, "Refactor during migration for better maintainability"),
    (8.0, "Significant refactoring required, consider redesign"),
)
NUMERIC_REWRITE = "Complex migration - consider complete rewrite"
RISK_COMPLEX = "High complexity may require extended testing"
RISK_DEPENDENCIES = "Many dependencies may cause integration issues"
RISK_LEGACY = "Legacy code patterns may be difficult to modernize"
RISK_STANDARD = "Standard migration risks apply"

# Whole-system texts by readiness, buffered days and cost.
OVERALL_APPROACHES = (
    (80, "Direct Migration - System is well-suited for modernization"),
    (60, "Phased Migration - Migrate in stages starting with low-risk components"),
    (40, "Hybrid Approach - Maintain legacy system while building new components"),
)
OVERALL_FALLBACK = "Strangler Fig Pattern - Gradually replace legacy system piece by piece"
TIMELINES = ((30, "1 month"), (90, "2-3 months"), (180, "4-6 months"), (365, "6-12 months"))
TIMELINE_BEYOND = "12+ months (consider breaking into smaller projects)"
COST_PER_DAY = 1000
PROJECT_SIZES = ((50000, "Small"), (250000, "Medium"), (1000000, "Large"))
LARGEST_PROJECT = "Enterprise"
DISRUPTIONS = (
    (70, "Low disruption expected - system is migration-ready"),
    (50, "Moderate disruption - requires careful planning"),
)
DISRUPTION_HIGH = "High disruption risk - consider phased approach"

# Risks every migration carries.
GENERAL_RISKS = (
    "Business disruption during migration phases",
    "Data loss or corruption during migration",
    "Integration failures with external systems",
    "Performance degradation post-migration",
)


def _n(col: str) -> Column:
    return F.coalesce(F.size(F.col(col)), F.lit(0))


def _is(kind: str) -> Column:
    return F.col("type") == kind


def complexity_points() -> Column:
    base = (
        F.when(_is("corba_interface"), 15 + 2 * _n("methods") + F.when(_n("inheritance") > 0, 10).otherwise(0))
        .when(_is("class"), 5 + _n("methods") + F.coalesce(F.col("complexity"), F.lit(0)))
        .when(_is("function"), F.coalesce(F.col("complexity"), F.lit(0)))
        .otherwise(0)
    )
    return base + 3 * _n("design_patterns") + 2 * _n("business_logic_patterns")


def complexity_level(points: Column) -> Column:
    return ladder([(points < top, name) for top, name in LEVELS], TOP_LEVEL)


def effort_hours(level: Column) -> Column:
    base = lookup(LEVEL_HOURS, level, 24)
    return (
        F.when(_is("corba_interface"), base * 1.5)
        .when(_is("class"), base + 2.0 * _n("methods"))
        .otherwise(base.cast("double"))
    )


def effort_text(hours: Column) -> Column:
    return F.when(
        hours < 40, F.concat(F.floor(hours).cast("string"), F.lit(" hours"))
    ).otherwise(F.concat(F.floor(hours / 8).cast("string"), F.lit(" days")))


def billed_hours(hours: Column) -> Column:
    """Hours as the totals count them: whole days from 40 hours on."""
    return F.when(hours < 40, F.floor(hours)).otherwise(F.floor(hours / 8) * 8).cast("long")


def risk_points(level: Column) -> Column:
    derived = (_n("inheritance") > 0) | (_n("base_classes") > 0)
    return (
        lookup(RISK_OF_LEVEL, level, 2)
        + F.when(_is("corba_interface"), 2).otherwise(0)
        + F.when(derived, 1).otherwise(0)
        + F.when(_n("business_logic_patterns") > 0, 1).otherwise(0)
    )


def risk_level(points: Column) -> Column:
    return ladder([(points <= top, name) for top, name in RISKS], TOP_RISK)


def rework_approach() -> Column:
    patterned = _is("class") & (_n("design_patterns") > 0)
    has = lambda p: F.array_contains("design_patterns", p)
    return ladder(
        [
            (_is("corba_interface"), REWORK_INTERFACE),
            (_is("corba_struct"), REWORK_STRUCT),
            (patterned & has("Singleton"), REWORK_SINGLETON),
            (patterned & has("Factory"), REWORK_FACTORY),
            (patterned, REWORK_PATTERN),
        ],
        REWORK_OTHER,
    )


def dependency_count() -> Column:
    return F.least(F.lit(99), _n("inheritance") + _n("base_classes") + _n("function_calls"))


def priority_points(risk: Column, level: Column, deps: Column) -> Column:
    return (
        lookup(PRIORITY_OF_RISK, risk, 2)
        + lookup(PRIORITY_OF_LEVEL, level, 1)
        + F.when(deps > 10, 1.0).when(deps > 5, 0.5).otherwise(0.0)
    )


def priority(points: Column) -> Column:
    return ladder([(points >= low, rank) for low, rank in PRIORITIES], LAST_PRIORITY)


def component_type(kind: Column) -> Column:
    return lookup(COMPONENT_TYPES, kind, "Component")


def score_components(entities: DataFrame) -> DataFrame:
    """One scored component row per class, function, IDL interface or struct."""
    return (
        entities.filter(F.col("type").isin(*SCORED_KINDS))
        .withColumn("points", complexity_points())
        .withColumn("level", complexity_level(F.col("points")))
        .withColumn("effort_hours", effort_hours(F.col("level")))
        .withColumn("risk_points", risk_points(F.col("level")))
        .withColumn("risk_level", risk_level(F.col("risk_points")))
        .withColumn("approach", rework_approach())
        .withColumn("n_deps", dependency_count())
        .withColumn("priority_points", priority_points(F.col("risk_level"), F.col("level"), F.col("n_deps")))
        .withColumn("priority", priority(F.col("priority_points")))
        .withColumn("component_type", component_type(F.col("type")))
        .withColumn("effort_text", effort_text(F.col("effort_hours")))
        .withColumn("billed_hours", billed_hours(F.col("effort_hours")))
    )


# ---- numeric model -------------------------------------------------------


def numeric_complexity() -> Column:
    return (
        F.least(F.coalesce(F.col("complexity"), F.lit(0)) / 20.0, F.lit(5.0))
        + F.least(_n("dependencies") / 10.0, F.lit(3.0))
        + F.least(F.col("n_rules") / 5.0, F.lit(2.0))
        + F.when(contains_any(F.lower(F.col("file_path")), INTEGRATION_WORDS), 2.0).otherwise(0.0)
    )


def criticality() -> Column:
    path = F.lower(F.col("file_path"))
    rules = F.col("n_rules")
    points = F.when(rules >= 5, 3).when(rules >= 2, 2).when(rules >= 1, 1).otherwise(0) + F.when(
        contains_any(path, CRITICAL_WORDS), 2
    ).when(contains_any(path, IMPORTANT_WORDS), 1).otherwise(0)
    return ladder([(points >= low, name) for low, name in CRITICALITIES], "low")


def numeric_effort(score: Column) -> Column:
    base = lookup(KIND_HOURS, F.col("type"), 20)
    # A hair of slack keeps truncation equal across engines at whole numbers.
    return F.floor(base * (1 + score / 10) * (1 + _n("dependencies") * 0.1) + 1e-9).cast("int")


def numeric_approach(score: Column) -> Column:
    return ladder([(score <= top, text) for top, text in NUMERIC_APPROACHES], NUMERIC_REWRITE)


def risk_list(score: Column) -> Column:
    found = present(
        F.when(score > 7.0, RISK_COMPLEX),
        F.when(_n("dependencies") > 10, RISK_DEPENDENCIES),
        F.when(contains_any(F.lower(F.col("file_path")), LEGACY_WORDS), RISK_LEGACY),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(RISK_STANDARD)))


def score_numeric(entities: DataFrame) -> DataFrame:
    raw = F.col("raw_score")
    return (
        entities.withColumn("raw_score", F.round(numeric_complexity(), 6))
        .withColumn("complexity_score", F.bround(raw, 1))
        .withColumn("criticality", criticality())
        .withColumn("criticality_rank", lookup(CRITICALITY_RANK, F.col("criticality"), 1))
        .withColumn("effort_hours", numeric_effort(raw))
        .withColumn("approach", numeric_approach(raw))
        .withColumn("risks", risk_list(raw))
    )


# ---- whole-system ladders --------------------------------------------------


def impact_risk(direct: Column, total: Column) -> Column:
    steps = [((direct <= d) & (total <= t), name) for d, t, name in IMPACT_RISKS]
    return ladder([(direct == 0, "Low"), *steps], "Critical")


def overall_approach(readiness: Column) -> Column:
    return ladder([(readiness >= low, text) for low, text in OVERALL_APPROACHES], OVERALL_FALLBACK)


def timeline(days: Column, high_risk: Column) -> Column:
    """Five buffer days per high-risk component."""
    buffered = days + high_risk * 5
    return ladder([(buffered <= top, text) for top, text in TIMELINES], TIMELINE_BEYOND)


def investment(days: Column) -> Column:
    cost = days * COST_PER_DAY
    size = ladder([(cost < top, name) for top, name in PROJECT_SIZES], LARGEST_PROJECT)
    return F.concat(F.lit("$"), F.format_number(cost, 0), F.lit(" ("), size, F.lit(" project)"))


def disruption(readiness: Column) -> Column:
    return ladder([(readiness >= low, text) for low, text in DISRUPTIONS], DISRUPTION_HIGH)
