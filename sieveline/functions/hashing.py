"""Hashes of texts, configurations and people."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    """SHA-256 with every line ending read as a line feed."""
    return F.sha2(F.regexp_replace(text, "\\r\\n?", "\n"), 256)


def keyed_hash(secret: str, message: Column) -> Column:
    """HMAC-SHA-256. Only the padded keys leave the driver; the rows stay in the JVM."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner_pad, outer_pad = (bytearray(b ^ pad for b in key) for pad in (0x36, 0x5C))
    inner = F.sha2(F.concat(F.lit(inner_pad), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer_pad), F.unhex(inner)), 256)


def canonical_json(value: object) -> str:
    """Keys sorted at every level, nulls kept, no blanks: equal configurations read equal."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def config_hash(config: dict) -> str:
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()


def canonical_json_column(fields: dict[str, Column]) -> Column:
    """The same form for a table's columns: fields in key order, nulls kept."""
    return F.to_json(
        F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"}
    )
