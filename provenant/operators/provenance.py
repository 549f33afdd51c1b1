"""Stamps: whether claim files name their sources, and whether stamps, extracts, sources and run records still agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.operators.records import seal_of

# Fields of a source's identity and of a stamp, and the verifier's version.
IDENTITY, LOCATORS = ("file", "source_version", "retrieved"), ("doi", "pmcid", "url")
STAMP = ("source_sha256", "extract_sha256", "body_sha256", "verifier_version", "verified_verdict", "verified_date")
SAME = ("file", "doi", "pmcid", "url", "retrieved")
VERSION = 2
_HEX = "^[0-9a-f]{64}$"


def _of(name: str) -> Column:
    return F.trim(F.coalesce(F.regexp_replace(F.col("frontmatter")[name], '^"|"$', ""), F.lit("")))


def _told(files: DataFrame, codes: list[tuple[Column, str]]) -> DataFrame:
    """key, code for each condition that holds."""
    return files.select("key", F.explode(F.array_compact(F.array(*(F.when(on, F.lit(code)) for on, code in codes)))).alias("code"))


def unset(value: Column) -> Column:
    """Empty, or a template's token."""
    return (value == "") | value.startswith("<")


def identity_problems(files: DataFrame) -> DataFrame:
    """key, code of files (key, frontmatter) that don't name their source: its fields, or any of the locators."""
    return _told(files, [(unset(_of(f)), f"no {f}") for f in IDENTITY] + [(unset(_of("doi")) & unset(_of("pmcid")) & unset(_of("url")), "no locator")])


def _unbound() -> list[tuple[Column, str]]:
    bound = _of("extract_source_sha256")
    return [((bound != "") & ~bound.rlike(_HEX), "extract source is no hash"), ((bound != "") & bound.rlike(_HEX) & (bound != _of("source_sha256")), "extract of another source")]


def stamp_problems(files: DataFrame) -> DataFrame:
    """key, code of stamps (files: key, frontmatter, body) by their shape and by the body they stand over."""
    hashes = [((_of(f) != "") & ~_of(f).rlike(_HEX), f"{f} is no hash") for f in STAMP[:3]]
    verdict, version = _of("verified_verdict"), _of("verifier_version").try_cast("int")
    return _told(files, [(_of(f) == "", f"no {f}") for f in STAMP] + hashes + [((verdict != "") & (verdict != "pass"), "verdict"), (F.coalesce(version < VERSION, F.lit(False)), "old version")] + _unbound() + [(_of("body_sha256").rlike(_HEX) & (_of("body_sha256") != F.sha2("body", 256)), "body changed")])


def binding_problems(files: DataFrame, extracts: DataFrame, sources: DataFrame) -> DataFrame:
    """key, code of files whose stamp no longer holds. extracts: key, extract_sha. sources: file, source_sha. Those absent aren't compared."""
    each = files.withColumn("file", _of("file")).join(extracts, "key", "left").join(sources, "file", "left")
    stamped = each.filter((_of("source_sha256") != "") & (_of("extract_sha256") != ""))
    none = each.filter((_of("source_sha256") == "") | (_of("extract_sha256") == "")).select("key", F.lit("no stamp").alias("code"))
    return none.unionByName(_told(stamped, [(_of("verified_verdict") != "pass", "verdict"), (F.coalesce(F.col("extract_sha") != _of("extract_sha256"), F.lit(False)), "extract changed")] + _unbound() + [(F.coalesce(F.col("source_sha") != _of("source_sha256"), F.lit(False)), "source changed"), (_of("body_sha256") == "", "no body hash"), ((_of("body_sha256") != "") & (_of("body_sha256") != F.sha2("body", 256)), "body changed")]))


def unbound(files: DataFrame) -> DataFrame:
    """key of stamped files whose extract names no source."""
    return files.filter((_of("source_sha256") != "") & (_of("extract_source_sha256") == "")).select("key")


def run_problems(files: DataFrame, runs: DataFrame) -> DataFrame:
    """key, code of run records (key, record; one a key) against files (key, frontmatter, body)."""
    each = files.join(runs.select("key", "record", F.lit(True).alias("there")), "key", "left")
    get = lambda f: F.coalesce(F.get_json_object("record", f"$.{f}"), F.lit(""))
    readable = F.coalesce(F.get_json_object("record", "$").startswith("{"), F.lit(False))
    absent = each.filter("there is null").select("key", F.lit("no run record").alias("code"))
    broken = each.filter(F.col("there") & ~readable).select("key", F.lit("unreadable").alias("code"))
    whole = each.filter(F.col("there") & readable).withColumn("seal", seal_of(F.col("record")))
    body = F.sha2("body", 256)
    codes = [(get("record_sha256") != F.col("seal"), "seal"), (get("body_sha256") != body, "body differs from the file"), (get("body_sha256") != _of("body_sha256"), "body differs from the stamp")]
    codes += [(get(f) != _of(f), f"{f} differs") for f in SAME] + [(get("verifier_version") != _of("verifier_version"), "version differs"), (F.trim(get("extract_tool_version")) == "", "no tool version")]
    return absent.unionByName(broken).unionByName(_told(whole, codes))


def state(files: DataFrame, problems: DataFrame, signed: DataFrame) -> DataFrame:
    """One row, level: empty without stamped files, unverified if some stamp has a problem, attested if every one has a signature, else reproducible."""
    stamped = files.filter(_of("body_sha256") != "").select("key").distinct()
    each = stamped.join(problems.select("key").distinct().withColumn("bad", F.lit(True)), "key", "left").join(signed.select("key").distinct().withColumn("good", F.lit(True)), "key", "left")
    return each.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), F.count_if("good").alias("good")).select(F.when(F.col("n") == 0, "empty").when(F.col("bad") > 0, "unverified").when(F.col("good") == F.col("n"), "attested").otherwise("reproducible").alias("level"))


def stamped_record(files: DataFrame, day: str) -> DataFrame:
    """key and run (JSON, sealed) of each file (key, frontmatter, body): the record of a verification on that day."""
    names = ["key", "verified_date", "verified_verdict", "verifier_version", "source_sha256", "extract_sha256", "body_sha256", *SAME]
    values = {"key": F.col("key"), "verified_date": F.lit(day), "verifier_version": F.lit(str(VERSION)), "body_sha256": F.sha2("body", 256)}
    plain = files.select("key", F.to_json(F.struct(*(values.get(n, _of(n)).alias(n) for n in names))).alias("plain"))
    return plain.select("key", F.concat(F.expr("left(plain, length(plain) - 1)"), F.lit(',"record_sha256":"'), seal_of(F.col("plain")), F.lit('"}')).alias("run"))
