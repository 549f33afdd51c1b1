"""Whether inferences keep to what their quotes say: a benchmark, verdicts, a detector by rules, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import text as X
from provenant.operators.metrics import confusion

# The two labels and words for them.
POSITIVE, NEGATIVE = "out-of-context", "apt"
POSITIVES = ("out-of-context", "out of context", "ooc", "misuse", "misused", "unfaithful", "stretch", "overreach", "no", "fail")
NEGATIVES = ("apt", "faithful", "in-context", "in context", "ok", "fine", "warranted", "yes", "pass")
# The detector's rules in order: on the inference, on the quote, not on the inference, and what they say.
RULES = (
    (r"\b(proves?|therefore no|must have|categorically|mathematically proven|perfectly safe)\b", None, None, "certainty"),
    (r"\bmost likely\b", r"cannot be excluded|possible|might", None, "likelihood"),
    (r"\b(was|is|cause|causes|therefore)\b", r"\bmight\b|can arise|cannot be excluded|warrant further studies", r"\bconsistent|possible|might|may|could|warrant|conclude\b", "hedge dropped"),
    (r"\bindependent(?:ly)? confirms?\b|separate lines? of evidence", r"not associated|associated|consumption|risk", None, "independence"),
    (r"\bgeneral population\b", r"subgroup|diabetic", None, "generalised"),
    (r"\bcause|causes|caused\b", r"associated|not associated", None, "causation"),
)


def normal_verdict(text: Column) -> Column:
    """A label, or null of words that are none."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(*POSITIVES), POSITIVE).when(low.isin(*NEGATIVES), NEGATIVE)


def detect(cases: DataFrame) -> DataFrame:
    """Adds verdict and rationale to cases (quote, inference), by the first rule that holds; null is read as empty."""
    has = lambda c, p: F.coalesce(F.col(c), F.lit("")).rlike(f"(?iU){p}")
    why = F.lit(None).cast("string")
    for inference, quote, unless, what in reversed(RULES):
        on = has("inference", inference)
        on = on & has("quote", quote) if quote else on
        on = on & ~has("inference", unless) if unless else on
        why = F.when(on, what).otherwise(why)
    return cases.withColumn("rationale", why).withColumn("verdict", F.when(F.col("rationale").isNotNull(), POSITIVE).otherwise(NEGATIVE))


def blind(cases: DataFrame) -> DataFrame:
    """What a detector may see."""
    return cases.select("id", F.coalesce("source_key", F.lit("")).alias("source"), F.coalesce("slug", F.lit("")).alias("slug"), "quote", "inference")


def balance(cases: DataFrame) -> DataFrame:
    return cases.groupBy().agg(F.count_if(F.col("gold") == POSITIVE).alias("n_positive"), F.count_if(F.col("gold") == NEGATIVE).alias("n_negative"))


def case_problems(cases: DataFrame) -> DataFrame:
    """id, code of cases that can't be scored: a field missing, or a gold label that is none."""
    missing = F.transform(F.filter(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in ("quote", "inference", "gold"))), lambda x: x["v"].isNull()), lambda x: F.concat(F.lit("no "), x["f"]))
    bad = F.when(F.col("gold").isNotNull() & ~F.col("gold").isin(POSITIVE, NEGATIVE), F.array(F.lit("gold"))).otherwise(F.array().cast("array<string>"))
    return cases.select("id", F.explode(F.concat(missing, bad)).alias("code"))


def score(cases: DataFrame, verdicts: DataFrame, *by: str) -> DataFrame:
    """The confusion of cases (id, gold) with verdicts (id, verdict); of several verdicts of an id the greatest counts, unknown words and ids without one are unscored."""
    one = verdicts.select("id", normal_verdict(F.col("verdict")).alias("said")).groupBy("id").agg(F.max("said").alias("said"))
    return confusion(cases.join(one, "id", "left").select(*by, (F.col("gold") == POSITIVE).alias("gold"), (F.col("said") == POSITIVE).alias("verdict")), *by)


def lost_quotes(cases: DataFrame, files: DataFrame) -> DataFrame:
    """id of cases whose quote isn't in the whole text of their claim file (key, text); without a file nothing is lost."""
    both = cases.select("id", F.col("source_key").alias("key"), "quote").join(files.select("key", "text"), "key")
    return both.filter(~F.contains(X.norm("text"), X.norm("quote"))).select("id")
