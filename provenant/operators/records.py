"""Seals of judgement records and manifests: the digest of a record without its own digest."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The field that a record's seal stands in, and a manifest's.
RECORD_SEAL, MANIFEST_SEAL = "record_sha256", "manifest_sha256"


def digest(record: str | None, seal: str = RECORD_SEAL) -> str | None:
    """SHA-256, in hex, of a JSON object with sorted keys and without its seal; None of anything else."""
    try:
        fields = json.loads(record or "")
    except ValueError:
        return None
    if not isinstance(fields, dict):
        return None
    fields.pop(seal, None)
    return hashlib.sha256(json.dumps(fields, sort_keys=True, ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()


def seal_of(record: Column, seal: str = RECORD_SEAL) -> Column:
    """The digest that a record's seal has to equal. Spark's own JSON writer spaces differently, so Python writes it."""

    @F.pandas_udf(T.StringType())
    def made(x: pd.Series) -> pd.Series:
        return x.map(lambda r: digest(r, seal))

    return made(record)


def sealed(record: Column, seal: str = RECORD_SEAL) -> Column:
    """Whether a record carries the digest of its other fields; false where it has none or is no object."""
    return F.coalesce(F.get_json_object(record, f"$.{seal}") == seal_of(record, seal), F.lit(False))
