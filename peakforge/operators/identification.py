"""Validation of identification results: an ordered rule chain written as one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.functions.scalars import capitalise

LETTERS = "^[a-zA-Z]+$"


def species_token(raw: Column) -> Column:
    """Second word of a pattern up to the first character that is no letter, digit, newline or dot."""
    return F.get(F.split(F.regexp_replace(raw, r"[^a-zA-Z0-9 \n.]", " "), " "), F.lit(0))


def validate_matches(df: DataFrame, threshold: float = 1.7, top: int = 3) -> DataFrame:
    """Add genus, species, status, reason and warning to (extern_id, target_position, matches).

    The first failing rule gives the reason: missing fields, bad id, low best score, a name that is no word, then for each
    further match a genus or species that differs at a score of at least ``threshold``. A species that differs at a lower
    score is accepted with a warning. Rows with fewer than ``top`` matches or a one-word pattern are rejected.
    """
    for k in range(top):
        match = F.get("matches", F.lit(k))
        words = F.split(F.trim(match["pattern"]), r"\s+")
        df = df.withColumns({f"_has{k}": match.isNotNull(), f"_score{k}": F.coalesce(match["score"], F.lit(0.0)),
                             f"_words{k}": F.size(words), f"_genus{k}": F.get(words, F.lit(0)),
                             f"_species{k}": species_token(F.get(words, F.lit(1)))})

    def absent(c):
        return F.col(c).isNull() | (F.col(c) == "")

    def name_rules(chain, k):
        n = k + 1
        return (chain.when(~F.col(f"_has{k}"), "too_few_matches")
                .when(F.coalesce(F.col(f"_words{k}"), F.lit(0)) < 2, f"bad_pattern_{n}")
                .when(~F.col(f"_species{k}").rlike(LETTERS), f"bad_species_{n}"))

    reason = (F.when(absent("extern_id") | absent("target_position") | F.col("matches").isNull()
                     | (F.size("matches") <= 0), "missing_attributes")
              .when((F.length("extern_id") < 8) | ~F.col("extern_id").rlike("^[0-9]{8}"), "bad_extern_id")
              .when(F.col("_score0") < threshold, "low_score"))
    reason = name_rules(reason, 0)
    warnings = []
    for k in range(1, top):
        reason = name_rules(reason, k)
        high = F.col(f"_score{k}") >= threshold
        reason = (reason.when((F.col("_genus0") != F.col(f"_genus{k}")) & high, f"genus_mismatch_{k + 1}")
                  .when((F.col("_species0") != F.col(f"_species{k}")) & high, f"species_mismatch_{k + 1}"))
        warnings.append(F.when((F.col("_species0") != F.col(f"_species{k}")) & ~high, f"species_mismatch_{k + 1}"))
    df = df.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    warning = F.concat_ws(",", *warnings) if warnings else F.lit("")
    keep = [c for c in df.columns if not c.startswith("_") and c != "reason"]
    return df.select(
        *keep,
        F.when(ok, F.col("_genus0")).alias("genus"),
        F.when(ok, capitalise("_species0")).alias("species"),
        F.when(ok, "accepted").otherwise("rejected").alias("status"),
        "reason",
        F.when(ok & (warning != ""), warning).alias("warning"),
    )


def accepted(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Accepted rows; ``limit`` is the trial mode that takes so many, the first by sample id and target position.

    The order is total up to rows that are equal in every plain column, so a trial gives the same rows again.
    """
    out = df.filter(F.col("status") == "accepted")
    if limit is None:
        return out
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct")]
    first = [c for c in ("extern_id", "target_position") if c in plain]
    return out.orderBy(*first, *[c for c in plain if c not in first]).limit(limit)


def normalise_species(df: DataFrame, column: str = "species") -> DataFrame:
    """Split a public label such as ``MIX!Klebsiella pneumoniae[A]`` into genus and species; one-word labels drop out."""
    words = F.split(F.col(column), " ")
    genus = capitalise(F.get(words, F.lit(0)))
    genus = F.when(genus.startswith("Mix!"), capitalise(genus.substr(F.lit(5), F.length(genus)))).otherwise(genus)
    species = capitalise(F.get(F.split(F.get(words, F.lit(1)), r"\["), F.lit(0)))
    rest = [c for c in df.columns if c not in (column, "genus", "species")]
    return df.filter(F.size(words) >= 2).select(*rest, genus.alias("genus"), species.alias("species"))
