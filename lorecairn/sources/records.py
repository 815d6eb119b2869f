"""Stored JSON records to typed rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import schemas

# Fixed values -------------------------------------------------------------
#: Bookkeeping fields of stored records that carry no data.
SYSTEM_FIELDS = ("_id", "_rev")
#: Stored name -> column name.
DOCUMENT_NAMES = {"_key": "key"}
TOPIC_NAMES = {"_key": "key"}
LINK_NAMES = {"_from": "from_id", "_to": "to_id"}
DOCUMENT_REQUIRED = ("title", "content", "tags", "metadata")
TOPIC_REQUIRED = ("name", "description")
LINK_REQUIRED = ("_from", "_to", "type")
# ---------------------------------------------------------------------------


def _stored_schema(schema: T.StructType, names: dict[str, str]) -> T.StructType:
    back = {column: stored for stored, column in names.items()}
    return T.StructType(
        [T.StructField(back.get(f.name, f.name), f.dataType, f.nullable) for f in schema]
    )


def _missing(present: Column, required: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(r) for r in required]), present)) > 0


def decode_records(
    lines: DataFrame,
    schema: T.StructType,
    names: dict[str, str],
    required: tuple[str, ...],
    system_fields: tuple[str, ...] = SYSTEM_FIELDS,
) -> DataFrame:
    """Parse ``lines.value``; adds the typed columns and ``problem``, null for a good record.

    A record with a field the schema does not have is a problem, as is one
    that lacks a required field or is no JSON object.
    """
    stored = _stored_schema(schema, names)
    # The plain name is accepted beside the stored one, as in exported rows.
    allowed = [F.lit(n) for n in (*stored.names, *schema.names, *system_fields)]
    fields = F.json_object_keys("value")
    nested = F.lit(False)
    if "metadata" in schema.names and isinstance(schema["metadata"].dataType, T.StructType):
        known = [F.lit(n) for n in schema["metadata"].dataType.names]
        inner = F.json_object_keys(F.get_json_object("value", "$.metadata"))
        nested = F.coalesce(F.size(F.array_except(inner, F.array(*known))) > 0, F.lit(False))
    problem = (
        F.when(fields.isNull(), "malformed")
        .when(F.size(F.array_except(fields, F.array(*allowed))) > 0, "unknown_field")
        .when(nested, "unknown_field")
        .when(_missing(fields, required), "missing_field")
    )
    parsed = lines.select(
        problem.alias("problem"), F.from_json("value", stored).alias("record")
    )
    return parsed.select(
        *[F.col(f"record.{s}").alias(names.get(s, s)) for s in stored.names], "problem"
    )


def _with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return rows.fillna({k: v for k, v in defaults.items() if k in rows.columns})


def decode_documents(lines: DataFrame) -> DataFrame:
    rows = decode_records(lines, schemas.DOCUMENTS, DOCUMENT_NAMES, DOCUMENT_REQUIRED)
    filled = _with_defaults(
        rows, {"confidence": schemas.DEFAULT_CONFIDENCE, "status": schemas.DEFAULT_STATUS}
    )
    version = F.coalesce("metadata.version", F.lit(1))
    return filled.withColumn(
        "metadata",
        F.when(F.col("metadata").isNotNull(), F.col("metadata").withField("version", version)),
    )


def decode_topics(lines: DataFrame) -> DataFrame:
    return decode_records(lines, schemas.TOPICS, TOPIC_NAMES, TOPIC_REQUIRED)


def decode_links(lines: DataFrame) -> DataFrame:
    rows = decode_records(
        lines, schemas.RELATIONSHIPS, LINK_NAMES, LINK_REQUIRED, (*SYSTEM_FIELDS, "_key")
    )
    return _with_defaults(
        rows, {"strength": schemas.DOCUMENT_LINK_STRENGTH, "bidirectional": False}
    )


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where("problem is null").drop("problem")


def rejected(decoded: DataFrame) -> DataFrame:
    return decoded.where("problem is not null")


def _encode(rows: DataFrame, names: dict[str, str], extra: list[Column] = ()) -> DataFrame:
    back = {column: stored for stored, column in names.items()}
    columns = [F.col(c).alias(back.get(c, c)) for c in rows.columns]
    return rows.select(F.to_json(F.struct(*columns, *extra)).alias("value"))


def encode_documents(docs: DataFrame) -> DataFrame:
    return _encode(docs, DOCUMENT_NAMES)


def encode_topics(topics: DataFrame) -> DataFrame:
    return _encode(topics, TOPIC_NAMES)


def encode_links(links: DataFrame) -> DataFrame:
    return _encode(links, LINK_NAMES)
