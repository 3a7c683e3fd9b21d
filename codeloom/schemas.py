"""Declared schemas of the tables the engine reads and writes."""

from __future__ import annotations

FILES = "repo string, file_path string, size_bytes long, text string"

JOBS = (
    "job_id string, repository_path string, status string, created_at timestamp, completed_at timestamp, "
    "entities_count long, rules_count long, files_processed int, processing_time double"
)
JOB_PROGRESS = "progress_percentage int, current_step string, step_description string, progress_data string"

REPOSITORIES = "path string, name string, languages map<string,long>, total_files long, total_lines long"
TEMPLATES = "name string, description string, config string, is_default boolean, created_at timestamp"

LOGS = (
    "timestamp timestamp, level string, logger string, message string, module string, function string, "
    "line int, request_id string, exception string"
)

RULES = (
    "rule_id string, description string, confidence_score double, category string, code_reference string, "
    "entity_id string, module_path string, class_context string, method_context string, "
    "integration_points string, business_process string"
)

REPORTS = "job_id string, filename string, content string"
DEPTHS = ("minimal", "standard", "comprehensive", "exhaustive")
