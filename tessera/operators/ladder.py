"""The decision to answer or to abstain, from what retrieval and the requirements of a question have found: the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons by the kind of the first missing requirement, and the words of a request to get round a login.
MISSING = {
    "IDENTIFIER": "IDENTIFIER_NOT_IN_EVIDENCE", "PROTOCOL": "PROTOCOL_MISMATCH", "ATTRIBUTE": "MISSING_ATTRIBUTE_EVIDENCE", "ACTION": "MISSING_ACTION_EVIDENCE", "VALUE": "MISSING_VALUE_EVIDENCE",
    "UNIT": "MISSING_VALUE_EVIDENCE", "VALUE_KIND": "MISSING_VALUE_EVIDENCE", "POLARITY": "MISSING_VALUE_EVIDENCE", "REQUIREMENT_TYPE": "MISSING_REQUIREMENT_EVIDENCE",
}
RECOVERY = r"(?i)\b(reset\w*|recover\w*|restor\w*|bypass\w*|regain\w*|unlock\w*)"
CREDENTIAL = r"(?i)\b(password\w*|passcode|credential|login|administrator account)"
NO_ACCESS = r"(?i)\b(lost|forgot|forgotten|unknown|cannot|can't|without|no longer|no physical access|unable to reach)\b"
CLOSE = ("SAME_SERIES", "SAME_FAMILY")


def bypass(question: Column) -> Column:
    """Whether a question asks to recover or get round a credential without access."""
    text = F.coalesce(question, F.lit(""))
    return text.rlike(RECOVERY) & text.rlike(CREDENTIAL) & text.rlike(NO_ACCESS)


def margin(scores: Column) -> Column:
    """How far the best of ``scores`` (an array, best first) is from the second; null with fewer than two."""
    return F.when(F.size(scores) >= 2, F.abs(F.get(scores, F.lit(0)) - F.get(scores, F.lit(1))))


def decided(found: DataFrame, most: float, ratio: float | None = None, by_identity: bool = True) -> DataFrame:
    """``found`` with decision (ANSWER or ABSTAIN) and reason.

    Columns of ``found``: error_code (empty or null: none), exact_identifier, has_identity, known_identity,
    n_candidates, compatible, foreign, unknown_parameter (null: none), question, critical, sufficient, missing (kinds in order),
    unsupported_detail, vector_distance, lexical_score (null: none) and relation. ``most`` is the greatest distance of strong
    evidence; with ``ratio`` requirements that are met count only up to so many times that distance. Null flags are false.
    """
    col = F.col
    flag = lambda c: F.coalesce(col(c), F.lit(False))
    code = F.coalesce(col("error_code"), F.lit("")) != ""
    relation = F.coalesce(col("relation"), F.lit("UNKNOWN")) if by_identity else F.lit("UNKNOWN")
    abstain = lambda reason: F.struct(F.lit("ABSTAIN").alias("decision"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    answer = lambda reason: F.struct(F.lit("ANSWER").alias("decision"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    same = lambda other: F.when(relation == "EXACT_MODEL", "EXACT_MODEL_EVIDENCE").when(relation.isin(*CLOSE), "FAMILY_COMPATIBLE_EVIDENCE").otherwise(other)
    first = F.upper(F.coalesce(F.get(F.coalesce("missing", F.array().cast("array<string>")), F.lit(0)), F.lit("")))
    lacks = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in MISSING.items() for x in kv)), F.split(first, ":")[0]), F.lit("PARTIAL_EVIDENCE_ONLY"))
    too_far = F.lit(False) if ratio is None else F.coalesce(col("vector_distance") > most * ratio, F.lit(False))
    lexical, vector = col("lexical_score").isNotNull(), col("vector_distance").isNotNull()
    related = relation.isin("EXACT_MODEL", *CLOSE)
    choice = (
        F.when(code & ~flag("exact_identifier"), abstain("UNKNOWN_IDENTIFIER"))
        .when(flag("has_identity") & ~flag("known_identity"), abstain("MODEL_MISMATCH"))
        .when(F.coalesce(col("n_candidates"), F.lit(0)) == 0, abstain("NO_CANDIDATE"))
        .when(flag("has_identity") & ~flag("compatible"), abstain("MODEL_MISMATCH"))
        .when(flag("foreign"), abstain("CROSS_EQUIPMENT"))
        .when(col("unknown_parameter").isNotNull(), abstain("UNKNOWN_PARAMETER"))
        .when(bypass(col("question")), abstain("UNSUPPORTED_PROCEDURE"))
        .when(flag("critical") & ~flag("sufficient"), abstain(lacks))
        .when(flag("unsupported_detail"), abstain("INSUFFICIENT_EVIDENCE"))
        .when(flag("critical") & too_far, abstain("WEAK_RETRIEVAL_EVIDENCE"))
        .when(flag("exact_identifier"), answer("EXACT_IDENTIFIER_EVIDENCE"))
        .when(flag("critical"), answer(same("CONTRACT_REQUIREMENTS_COVERED")))
        .when(vector & (col("vector_distance") <= most), answer(same("STRONG_VECTOR_EVIDENCE")))
    )
    if by_identity:
        choice = choice.when(lexical & flag("compatible") & related, answer(same(""))).when(lexical & flag("compatible"), abstain("INSUFFICIENT_EVIDENCE"))
    else:
        choice = choice.when(lexical & flag("compatible"), answer("STRONG_LEXICAL_EVIDENCE"))
    choice = choice.when(lexical & vector, abstain("WEAK_RETRIEVAL_EVIDENCE")).otherwise(abstain("INSUFFICIENT_EVIDENCE"))
    return found.withColumn("choice", choice).withColumns({"decision": F.col("choice.decision"), "reason": F.col("choice.reason")}).drop("choice")
