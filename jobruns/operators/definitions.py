"""Checks of job definitions and the container specification derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobruns.constants import ACTION_TYPES, INVALID_CRON, POLICIES
from jobruns.functions.specs import (
    member_kind,
    runtime_spec,
    runtime_spec_error,
)
from jobruns.functions.text import blank_to_null, env_ok
from jobruns.operators.schedule import check_cron


def with_runtime_spec(jobs: DataFrame, shell_enabled: bool = True) -> DataFrame:
    """``jobs`` with ``runtime_spec`` and, where there can be none, ``spec_error``."""
    action, config = F.col("action_type"), F.col("action_config")
    return jobs.withColumns(
        {
            "runtime_spec": runtime_spec(action, config, shell_enabled),
            "spec_error": runtime_spec_error(action, config, shell_enabled),
        }
    )


def rederive_spec(before: DataFrame, after: DataFrame, shell_enabled: bool = True) -> DataFrame:
    """New specification of the jobs whose action type or configuration changed."""
    old = before.select(
        "job_id", F.col("action_type").alias("_old_type"), F.col("action_config").alias("_old_config")
    )
    changed = after.join(old, "job_id").where(
        ~F.col("action_type").eqNullSafe(F.col("_old_type"))
        | ~F.col("action_config").eqNullSafe(F.col("_old_config"))
    )
    return with_runtime_spec(changed.drop("_old_type", "_old_config"), shell_enabled)


_ACTION = ("action_type", "action_config")


def rules(columns: list[str]) -> list[tuple[Column, str, tuple[str, ...]]]:
    """Each rule: where it is broken, its text, and the columns it speaks of."""
    action, config = F.col("action_type"), F.col("action_config")
    is_http, is_shell = action == "http", action == "shell"
    kinds = {m: member_kind(config, m) for m in ("method", "url", "command", "headers", "body", "timeout_seconds")}
    given = {m: k.isNotNull() for m, k in kinds.items()}

    def is_text(member: str) -> Column:
        return F.coalesce(kinds[member] == "STRING", F.lit(False))

    # Whole numbers count in any spelling: 5, 5.0, "5", and true as 1. Null does not.
    timeout = F.trim(F.try_variant_get(F.try_parse_json(config), "$.timeout_seconds", "string"))
    whole = F.when(kinds["timeout_seconds"] == "BOOLEAN", (timeout == "true").cast("double")).when(
        timeout.rlike(r"^[+-]?[0-9]+(\.0*)?$"), timeout.cast("double")
    )
    bad_timeout = given["timeout_seconds"] & (F.coalesce(whole, F.lit(0.0)) < 1)
    header_values = F.try_variant_get(F.try_parse_json(config), "$.headers", "map<string,variant>")
    bad_headers = given["headers"] & (
        ~kinds["headers"].startswith("OBJECT")
        | F.coalesce(
            F.exists(F.map_values(header_values), lambda v: F.schema_of_variant(v) != "STRING"), F.lit(False)
        )
    )
    bad_body = given["body"] & ~kinds["body"].isin("STRING", "VOID") & ~kinds["body"].startswith("OBJECT")
    document = F.schema_of_variant(F.try_parse_json(config))
    found = [
        (blank_to_null(F.coalesce("name", F.lit(""))).isNull(), "empty name", ("name",)),
        (F.col("max_retries") < 0, "negative max_retries", ("max_retries",)),
        (action.isNull() | ~action.isin(*ACTION_TYPES), "unknown action_type", ("action_type",)),
        (F.col("concurrency_policy").isNull() | ~F.col("concurrency_policy").isin(*POLICIES), "unknown concurrency_policy", ("concurrency_policy",)),
        (document.isNull() | ~document.startswith("OBJECT"), "action_config is no JSON object", _ACTION),
        (is_http & ~is_text("url"), "missing url", _ACTION),
        (is_http & given["method"] & ~is_text("method"), "method is not text", _ACTION),
        (is_shell & ~is_text("command"), "missing command", _ACTION),
        (action.isin(*ACTION_TYPES) & bad_timeout, "timeout_seconds below 1", _ACTION),
        (is_http & bad_headers, "headers are not an object of strings", _ACTION),
        (is_http & bad_body, "body is neither text nor object", _ACTION),
    ]
    if "runtime_spec" in columns:
        found.append((~env_ok(F.col("runtime_spec.env")), "bad environment variable name", ("runtime_spec",)))
    return [(F.coalesce(broken, F.lit(False)), text, about) for broken, text, about in found]


def _faults(columns: list[str]) -> list[Column]:
    """One column per rule: its text where the rule is broken, else null."""
    return [F.when(broken, F.lit(text)) for broken, text, _ in rules(columns)]


def invalid_jobs(jobs: DataFrame, existing: DataFrame | None = None, expressions: DataFrame | None = None) -> DataFrame:
    """``job_id, reason``, one row per broken rule. Names must differ from each other and, where ``existing`` jobs are given, from
    theirs. ``expressions`` are those of ``schedule.settled``, if they are worked out already."""
    single = jobs.select("job_id", F.explode(F.array_compact(F.array(*_faults(jobs.columns)))).alias("reason"))

    # Names used more than once, found by counting; the jobs that bear them are joined back.
    twice = jobs.groupBy("name").agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col("name").isNotNull())
    duplicates = jobs.select("job_id", "name").join(twice.hint("merge"), "name", "left_semi").select(
        "job_id", F.lit("duplicate name").alias("reason")
    )

    if existing is not None:
        taken = existing.select("name").distinct().hint("merge")
        duplicates = duplicates.unionByName(
            jobs.join(taken, "name", "left_semi").select("job_id", F.lit("duplicate name").alias("reason"))
        ).distinct()
    expression = blank_to_null(F.col("cron_expression"))
    with_cron = jobs.select("job_id", expression.alias("cron_expression")).where(F.col("cron_expression").isNotNull())
    if expressions is None:
        checked = check_cron(with_cron)
    else:
        checked = with_cron.join(expressions.select("cron_expression", F.col("valid").alias("cron_ok")), "cron_expression")
    wrong = checked.where(~F.col("cron_ok")).select("job_id", F.lit(INVALID_CRON).alias("reason"))
    return single.unionByName(duplicates).unionByName(wrong)
