"""Action configurations and the container specification derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobruns.constants import DEFAULT_TIMEOUT_SECONDS, HTTP_IMAGE, SHELL_DISABLED, SHELL_IMAGE

HTTP_SCHEMA = "method STRING, url STRING, headers MAP<STRING, STRING>, body STRING, timeout_seconds INT"
SHELL_SCHEMA = "command STRING, timeout_seconds INT"

# One JSON token sequence up to a separator, strings taken whole.
_STRING = r'"(?:[^"\\]|\\.)*+"'


def http_config(config: Column) -> Column:
    """``struct<method, url, headers, body, timeout_seconds>`` with defaults filled in on reading."""
    c = F.from_json(config, HTTP_SCHEMA)
    return F.struct(
        F.coalesce(c["method"], F.lit("GET")).alias("method"),
        c["url"].alias("url"),
        F.coalesce(c["headers"], F.from_json(F.lit("{}"), "MAP<STRING, STRING>")).alias("headers"),
        c["body"].alias("body"),
        F.coalesce(c["timeout_seconds"], F.lit(DEFAULT_TIMEOUT_SECONDS)).alias("timeout_seconds"),
    )


def shell_config(config: Column) -> Column:
    c = F.from_json(config, SHELL_SCHEMA)
    return F.struct(
        c["command"].alias("command"),
        F.coalesce(c["timeout_seconds"], F.lit(DEFAULT_TIMEOUT_SECONDS)).alias("timeout_seconds"),
    )


def spaced_json(raw: Column) -> Column:
    """JSON text with one blank after every comma and colon and no other white space."""
    compact = F.regexp_replace(raw, rf"({_STRING})|\s+", "$1")
    return F.regexp_replace(compact, rf'\G((?:{_STRING}|[^",:])*+)([,:])', "$1$2 ")


def member_kind(config: Column, name: str) -> Column:
    """JSON type of a member of the configuration: STRING, OBJECT<...>, ARRAY<...>, VOID, ...; null when absent."""
    doc = F.try_parse_json(config)
    return F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant"))


def runtime_spec(action_type: Column, config: Column, shell_enabled: bool = True) -> Column:
    """``struct<image, command, env, timeout_seconds>``; null where :func:`runtime_spec_error` says why."""
    http, shell = http_config(config), shell_config(config)
    kind = member_kind(config, "body")
    body_text = F.when(
        kind.startswith("OBJECT") | kind.startswith("ARRAY"),
        spaced_json(F.get_json_object(config, "$.body")),
    ).otherwise(http["body"])

    headers = F.flatten(
        F.transform(
            F.map_entries(http["headers"]),
            lambda e: F.array(F.lit("-H"), F.concat(e["key"], F.lit(": "), e["value"])),
        )
    )
    no_words = F.array().cast("array<string>")
    http_command = F.concat(
        F.array(F.lit("curl"), F.lit("-fsS"), F.lit("-X"), F.upper(http["method"])),
        headers,
        F.when(body_text.isNotNull(), F.array(F.lit("-d"), body_text)).otherwise(no_words),
        F.array(http["url"]),
    )
    shell_command = F.array(F.lit("sh"), F.lit("-c"), shell["command"])

    def spec(image: str, command: Column, timeout: Column) -> Column:
        return F.struct(
            F.lit(image).alias("image"),
            command.alias("command"),
            F.from_json(F.lit("{}"), "MAP<STRING, STRING>").alias("env"),
            timeout.alias("timeout_seconds"),
        )

    out = F.when(
        (action_type == "http") & http["url"].isNotNull(),
        spec(HTTP_IMAGE, http_command, http["timeout_seconds"]),
    )
    if shell_enabled:
        out = out.when(
            (action_type == "shell") & shell["command"].isNotNull(),
            spec(SHELL_IMAGE, shell_command, shell["timeout_seconds"]),
        )
    return out


def runtime_spec_error(action_type: Column, config: Column, shell_enabled: bool = True) -> Column:
    """Why no container specification can be derived; null when one can."""
    out = F.when(
        action_type.isNull() | ~action_type.isin("http", "shell"),
        F.concat(F.lit("Unsupported action_type: "), F.coalesce(action_type, F.lit("null"))),
    )
    if not shell_enabled:
        out = out.when(action_type == "shell", F.lit(SHELL_DISABLED))
    return out.when(
        (action_type == "http") & http_config(config)["url"].isNull(), F.lit("missing url")
    ).when((action_type == "shell") & shell_config(config)["command"].isNull(), F.lit("missing command"))
