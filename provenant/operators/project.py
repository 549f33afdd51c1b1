"""Projects as a whole: settings and postures, profiles, states, gates and their verdict, notes that link to one another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.operators.board import prefixes

# gates' settings with what they may be, the one that holds where none is given first, profiles' differences, fields that a project fills in.
POSTURES = {
    "claim_ids": ("optional", "off", "required"), "numeric_citations": ("warn", "ignore", "block"), "provenance": ("warn", "off", "required"), "structure_layer": ("optional", "off", "required"), "assessment_layer": ("optional", "off", "required"),
    "graph_coverage": ("off", "warn", "required"), "edge_assessments": ("off", "warn", "required"), "selection_audit": ("off", "warn", "required"), "source_flow": ("off", "warn", "required"), "units_layer": ("off", "warn", "required"),
    "synthesis_claims": ("off", "warn", "required"), "semantic_health": ("warn", "off", "required"), "attestation": ("off", "warn", "required"),
}
STRICT = {"claim_ids": "required", "numeric_citations": "block", "provenance": "required", "structure_layer": "required", "assessment_layer": "required"}
_LAYERS = ("edge_assessments", "selection_audit", "source_flow", "units_layer", "synthesis_claims")
PROFILES = {
    "pristine": {k: v[0] for k, v in POSTURES.items()},
    "strict-local": {k: v[0] for k, v in POSTURES.items()} | STRICT | dict.fromkeys(_LAYERS, "warn"),
    "submission": {k: v[0] for k, v in POSTURES.items()} | STRICT | dict.fromkeys((*_LAYERS, "graph_coverage", "semantic_health"), "required") | {"attestation": "warn"},
}
REQUIRED = ("project_name", "deliverable", "source_of_truth", "the_reader", "source_types")
#: Gates in the order in which they depend on one another, each with its setting.
GATES = (
    ("project health", None), ("quote check", None), ("provenance stamps", "provenance"), ("citation coverage", None), ("claim-graph structure", "structure_layer"), ("assessment records", "assessment_layer"), ("claim coverage", "graph_coverage"),
    ("run-record attestation", "attestation"), ("selection audit", "selection_audit"), ("source flow", "source_flow"), ("unit manifests", "units_layer"), ("synthesis claims", "synthesis_claims"), ("wiki health", None),
)
BLOCKING = ("required", "block")
STALE_AFTER = 180
ENTRIES = ("index", "crosswalk", "log", "readme", "inquiry", "source_register", "source_flow", "finding", "baseline_comparison", "correlation_kinds")


def postures(settings: DataFrame) -> DataFrame:
    """project, gate, value, given of every setting of each project of settings (project, name, value); values that may not be are as none."""
    spark = settings.sparkSession
    table = spark.createDataFrame([(k, v[0], list(v)) for k, v in POSTURES.items()], "gate string, usual string, allowed array<string>")
    own = settings.select("project", F.col("name").alias("gate"), F.lower("value").alias("own"))
    each = settings.select("project").distinct().join(F.broadcast(table))
    given = F.coalesce(F.array_contains("allowed", F.col("own")), F.lit(False))
    return each.join(own, ["project", "gate"], "left").select("project", "gate", F.when(given, F.col("own")).otherwise(F.col("usual")).alias("value"), given.alias("given"))


def profile_distance(held: DataFrame) -> DataFrame:
    """project, profile, distance, nearest: settings in which a project's postures differ from each profile's; all at the least distance are nearest."""
    table = held.sparkSession.createDataFrame([(p, k, v) for p, vs in PROFILES.items() for k, v in vs.items()], "profile string, gate string, wanted string")
    each = held.join(F.broadcast(table), "gate").groupBy("project", "profile").agg(F.count_if(F.col("value") != F.col("wanted")).alias("distance"))
    least = each.groupBy("project").agg(F.min("distance").alias("least"))
    return each.join(least, "project").select("project", "profile", "distance", (F.col("distance") == F.col("least")).alias("nearest"))


def strict_gaps(held: DataFrame) -> DataFrame:
    """project, gate, value, wanted of settings that a strict project has otherwise."""
    wanted = reduce(lambda a, kv: a.when(F.col("gate") == kv[0], kv[1]), STRICT.items(), F.when(F.lit(False), ""))
    return held.withColumn("wanted", wanted).filter("wanted is not null and value <> wanted").select("project", "gate", "value", "wanted")


def placeholder(value: Column) -> Column:
    return F.coalesce((F.trim(value) == "") | F.trim(value).startswith("<"), F.lit(True))


def missing_paths(settings: DataFrame, files: DataFrame) -> DataFrame:
    """project, path of what projects gate that isn't there: settings (project, name, value), files (project, path below the root).

    A gated path is there if it is a file's or that of a folder above one.
    """
    get = F.max(F.when(F.col("name") == "gated_paths", F.col("value"))).alias("value")
    asked = settings.groupBy("project").agg(get).select("project", F.explode(F.array_distinct(prefixes(F.col("value")))).alias("path"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    there = files.select("project", F.explode(above).alias("__place")).distinct()
    return asked.withColumn("__place", F.regexp_replace("path", "/+$", "")).join(there, ["project", "__place"], "left_anti").select("project", "path")


def states(settings: DataFrame, rules: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """project, state: pristine, drafted, configured or broken, from what is filled in and written, against what is declared.

    settings: project, name, value. rules: project, written (whether its rules are more than the template's). With files
    (project, path), a project that gates a path that isn't there is broken and not configured.
    """
    get = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    each = settings.groupBy("project").agg(*(get(n).alias(n) for n in (*REQUIRED, "skin_state", "project_state"))).join(rules, "project", "left")
    open_ = reduce(lambda a, b: a + b, (placeholder(F.col(n)).cast("int") for n in REQUIRED))
    written, skin, declared = F.coalesce("written", F.lit(False)), F.lower("skin_state"), F.lower("project_state")
    draft, sure = F.coalesce(skin == "draft", F.lit(False)), F.coalesce(skin == "confirmed", F.lit(False))
    found = F.when((open_ == len(REQUIRED)) & ~written & ~draft, "pristine").when((open_ == 0) & draft, "drafted").when((open_ == 0) & written, "configured").otherwise("broken")
    each = each.withColumn("found", found)
    if files is not None:
        lost = missing_paths(settings, files).select("project").distinct().withColumn("lost", F.lit(True))
        each = each.join(lost, "project", "left").withColumn("found", F.when(F.col("lost") & (F.col("found") == "configured"), "broken").otherwise(F.col("found")))
    against = ((declared == "configured") & (F.col("found") == "drafted")) | (declared.isin("pristine", "configured") & F.col("found").isin("pristine", "configured") & (declared != F.col("found")))
    return each.select("project", F.when(F.coalesce(against, F.lit(False)), "broken").otherwise(F.col("found")).alias("state"))


def review_problems(reviews: DataFrame, today: str, most: int = STALE_AFTER) -> DataFrame:
    """project, code of reviews (project, last_review as eight digits): not set, or older than most days on today (yyyyMMdd)."""
    last = F.col("last_review")
    age = F.datediff(F.to_date(F.lit(today), "yyyyMMdd"), F.expr("try_to_date(last_review, 'yyyyMMdd')"))
    return reviews.select("project", F.when(F.coalesce(~last.rlike("^[0-9]{8}$"), F.lit(True)), "not set").when(age.isNull(), "not set").when(age > most, "stale").alias("code")).filter("code is not null")


def run_gates(problems: DataFrame, held: DataFrame, projects: DataFrame, unavailable: DataFrame) -> DataFrame:
    """project, place, gate, status, n, blocking of every gate: pass, fail, inactive, unavailable or not applicable.

    problems: project, gate, n. held: postures. projects: project, strict, n_files. unavailable: project, gate, whose means are
    absent: that blocks strict projects, but for a gate that is off. A gate that fails counts whatever its setting is if it is
    the project's own to set so; a setting below required only warns. The quote check has nothing to do without files.
    """
    table = projects.sparkSession.createDataFrame([(i, g, s) for i, (g, s) in enumerate(GATES)], "place int, gate string, setting string")
    each = projects.join(F.broadcast(table)).join(held.select("project", F.col("gate").alias("setting"), "value"), ["project", "setting"], "left")
    each = each.join(problems.groupBy("project", "gate").agg(F.sum("n").alias("n")), ["project", "gate"], "left").join(unavailable.select("project", "gate").distinct().withColumn("absent", F.lit(True)), ["project", "gate"], "left")
    n, off = F.coalesce("n", F.lit(0)), F.coalesce(F.col("value") == "off", F.lit(False))
    soft = F.coalesce(~F.col("value").isin(*BLOCKING), F.lit(False))
    status = F.when((F.col("gate") == "quote check") & (F.col("n_files") == 0), "not applicable").when(F.col("absent"), "unavailable").when((n > 0) & ~off, F.when(soft, "warn").otherwise("fail")).when(off, "inactive").otherwise("pass")
    made = each.select("project", "place", "gate", status.alias("status"), n.alias("n"), "strict", off.alias("off"))
    return made.select("project", "place", "gate", "status", "n", ((F.col("status") == "fail") | ((F.col("status") == "unavailable") & F.col("strict") & ~F.col("off"))).alias("blocking"))


def verdicts(gates: DataFrame) -> DataFrame:
    """project, exit (0 or 1), next: the first blocking gate, null without one."""
    return gates.groupBy("project").agg(F.max(F.col("blocking").cast("int")).alias("exit"), F.min_by("gate", F.when(F.col("blocking"), F.col("place"))).alias("next"))


def wiki_problems(notes: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """path, code, detail of notes (path, text) below a content folder, but for those of folders that the caller leaves out.

    Codes: path link, dead link, orphan (no note links to it, itself included; entry notes need none), uncatalogued (a note of
    the catalogued folders whose name the crosswalk's text, in its one row, doesn't hold anywhere).
    """
    stem = F.lower(F.regexp_extract("path", r"([^/]*)\.md$", 1))
    each = notes.withColumn("stem", stem)
    names = each.select(F.col("stem").alias("target")).distinct()
    links = each.select("path", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\[\[\s*([^\]|#]+?)\s*(?:[#|][^\]]*)?\]\]"), F.lit(1)), lambda t: F.lower(F.trim(t))))).alias("target"))
    dead = links.join(names, "target", "left_anti").select("path", F.when(F.contains("target", F.lit("/")), "path link").otherwise("dead link").alias("code"), F.col("target").alias("detail"))
    none = F.lit(None).cast("string").alias("detail")
    lone = each.filter(~F.col("stem").isin(*ENTRIES)).join(links.select(F.col("target").alias("stem")).distinct(), "stem", "left_anti").select("path", F.lit("orphan").alias("code"), none)
    listed = each.filter(F.col("path").rlike("(^|/)(concept_notes|literature_reviews)/")).join(F.broadcast(crosswalk.select(F.lower("text").alias("listed"))))
    return _all([dead, lone, listed.filter(~F.contains("listed", "stem")).select("path", F.lit("uncatalogued").alias("code"), none)])


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def gated(path: Column, prefixes: list[str]) -> Column:
    """Whether a path holds one of the prefixes anywhere and is no claim file."""
    hit = reduce(lambda a, b: a | b, (F.contains(path, F.lit(p)) for p in prefixes), F.lit(False))
    return hit & ~F.contains(path, F.lit("verified_claims/"))
