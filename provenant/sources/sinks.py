"""What a project's tables are written as: graphs as JSON, registers as tab-separated rows, stamps and manifests as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.operators.records import MANIFEST_SEAL, seal_of


def graph_json(parts: dict[str, DataFrame]) -> str:
    """A graph's tables as one JSON text with sorted keys; for graphs that a reader would open, as all rows come to the driver."""
    made = {name: sorted((json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).collect()), key=lambda x: json.dumps(x, sort_keys=True)) for name, df in parts.items()}
    return json.dumps(made, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated files with a header, in the rows' order."""
    rows.write.option("sep", "\t").option("header", True).option("emptyValue", "").mode("overwrite").csv(path)


def manifests(units: DataFrame, raw: DataFrame, day: str) -> DataFrame:
    """key, manifest (JSON, sealed) of sources: units (key, place, locus, text), raw (key, source_type, source_sha256)."""
    from provenant.functions.text import norm_digest

    each = units.select("key", F.struct("place", "locus", "text", norm_digest("text").alias("unit_sha256")).alias("u"))
    lists = each.groupBy("key").agg(F.transform(F.array_sort(F.collect_list("u")), lambda u: F.struct(u["locus"].alias("locus"), u["text"].alias("text"), u["unit_sha256"].alias("unit_sha256"))).alias("units"))
    none = F.array().cast("array<struct<locus:string,text:string,unit_sha256:string>>")
    fields = F.struct("key", "source_type", "source_sha256", F.lit("1").alias("enumerator_version"), F.lit(day).alias("enumerated_date"), F.lit("block-ordinal").alias("addressing"), (F.col("source_type") == "html").alias("fully_enumerable"), F.coalesce("units", none).alias("units"))
    plain = raw.join(lists, "key", "left").select("key", F.to_json(fields).alias("plain"))
    return plain.select("key", F.concat(F.expr("left(plain, length(plain) - 1)"), F.lit(f',"{MANIFEST_SEAL}":"'), seal_of(F.col("plain"), MANIFEST_SEAL), F.lit('"}')).alias("manifest"))
