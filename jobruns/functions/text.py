"""Text, identifiers and message bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobruns.constants import OUTPUT_CAP, TRUNCATION_NOTICE

_HEX32 = "^[0-9a-f]{32}$"

_JSON_OBJECT = r"^[ \t\n\r]*\{"
_JSON_NESTED = r"^[ \t\n\r]*[\{\[\"]"
_JSON_SCALAR = (
    r"^[ \t\n\r]*(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)[ \t\n\r]*$"
)
# Members that may be a number, a truth value or a text; their type has to be looked at.
_FALSY_LOOKING = ("", "0", "0.0", "-0", "true", "false")


def blank_to_null(col: Column) -> Column:
    """Strip white space at both ends; nothing left means null."""
    return F.nullif(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""), F.lit(""))


def name_contains(col: Column, q: str) -> Column:
    """Case-insensitive substring search; ``%`` and ``_`` in ``q`` stay wildcards."""
    return F.lower(col).like(f"%{q.lower()}%")


def truncate_output(col: Column, cap: int = OUTPUT_CAP) -> Column:
    """Text longer than ``cap`` characters is cut there and marked."""
    return F.when(
        F.length(col) > cap, F.concat(F.substring(col, 1, cap), F.lit(TRUNCATION_NOTICE))
    ).otherwise(col)


def decode_text(col: Column) -> Column:
    """Bytes as UTF-8 text, bad sequences replaced by U+FFFD."""
    return F.make_valid_utf8(col.cast("string"))


def env_key_ok(col: Column) -> Column:
    return col.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def env_ok(env: Column) -> Column:
    """Every key of an environment map is a valid variable name."""
    return F.forall(F.map_keys(env), env_key_ok)


def key_value_map(items: Column) -> Column:
    """``["K=V", ...]`` to a map, split at the first ``=``; an empty key is dropped, a later key wins."""
    pairs = F.transform(
        items,
        lambda s: F.struct(
            F.substring_index(s, "=", 1).alias("k"),
            F.coalesce(F.get(F.split(s, "=", 2), F.lit(1)), F.lit("")).alias("v"),
        ),
    )
    pairs = F.filter(pairs, lambda p: p["k"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(
        keys,
        lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"],
    )
    return F.map_from_arrays(keys, last)


def normalise_uuid(col: Column) -> Column:
    """Lower-case dashed form of a UUID in any usual spelling; null when it is not one."""
    bare = F.lower(F.regexp_replace(col, r"urn:|uuid:|[{}\-]", ""))
    dashed = F.concat_ws(
        "-",
        *[F.substring(bare, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))],
    )
    return F.when(bare.rlike(_HEX32), dashed)


def run_key(*parts: Column) -> Column:
    """Identifier of a new run in UUID form. It depends only on its inputs, so a step that is
    repeated after a failure writes the same runs again instead of new ones."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return normalise_uuid(F.substring(digest, 1, 32))


def task_id_of(body: Column) -> Column:
    """Task id carried by a message body; null means the message is to be dropped.

    A body that is not JSON is the id itself, a JSON string is the id, a JSON object holds it
    under ``task_id``; any other JSON value, and an empty, zero or false id, carries none.
    Only bodies that look like JSON are parsed.
    """
    # Read as the only element of a list, so that text after the document makes it invalid.
    listed = F.concat(F.lit("["), body, F.lit("]"))
    objects = F.from_json(listed, "ARRAY<STRUCT<task_id: STRING>>", {"allowSingleQuotes": "false"})
    member = F.get(objects, F.lit(0))["task_id"]
    plain_member = (
        body.rlike(_JSON_OBJECT) & (F.size(objects) == 1) & member.isNotNull() & ~member.isin(*_FALSY_LOOKING)
    )
    found = (
        F.when(plain_member, member)
        .when(body.rlike(_JSON_NESTED), _id_of_document(body))
        .when(body.rlike(_JSON_SCALAR), F.lit(None))
        .otherwise(body)
    )
    return F.nullif(found, F.lit(""))


def _id_of_document(body: Column) -> Column:
    def of(documents: Column) -> Column:
        doc = F.try_variant_get(documents, "$[0]", "variant")
        kind = F.schema_of_variant(doc)
        member = F.try_variant_get(doc, "$.task_id", "variant")
        member_kind = F.schema_of_variant(member)
        member_text = F.try_variant_get(doc, "$.task_id", "string")
        from_object = (
            F.when(member.isNull() | (member_kind == "VOID"), F.lit(None))
            .when(member_kind == "BOOLEAN", F.when(member_text == "true", F.lit("True")))
            .when(member_kind == "STRING", member_text)
            .otherwise(F.nullif(member_text, F.lit("0")))
        )
        return (
            F.when(doc.isNull() | F.try_variant_get(documents, "$[1]", "variant").isNotNull(), body)
            .when(kind == "STRING", F.try_variant_get(doc, "$", "string"))
            .when(kind.startswith("OBJECT"), from_object)
        )

    # transform over one element: the document is parsed once for all its uses.
    listed = F.concat(F.lit("["), body, F.lit("]"))
    return F.get(F.transform(F.array(F.try_parse_json(listed)), of), F.lit(0))
