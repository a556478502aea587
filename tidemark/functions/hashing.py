"""Content hashes, record identities and exact references."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def record_id(prefix: str, natural_key: Column) -> Column:
    """prefix_ and the first 24 hex digits of the key's SHA-256."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(natural_key, 256), 1, 24))


def material_hash(*fields: Column) -> Column:
    """Hash of normalised fields, null and empty being different."""
    return label(F.to_json(F.struct(*[f.alias(f"f{i}") for i, f in enumerate(fields)]), {"ignoreNullFields": "false"}))


def version_id(prefix: str, digest: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.regexp_replace(digest, "^sha256:", ""), 1, 12))


def ref_key(record: Column, revision: Column) -> Column:
    return F.concat_ws("@", record, revision.cast("string"))


def canonical_json(value: Any) -> str:
    """Keys sorted, no spaces, whole numbers without a point: for settings and small documents on the driver."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        value = int(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{canonical_json(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    return json.dumps(value, ensure_ascii=False)
