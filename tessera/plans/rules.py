"""Rules on a candidate and a record: each a status, null inputs decided first; scores with coverage; tiers.

A status is one of aggregates.SEVERITY. Facts count only if confirmed; what was not parsed but has text needs
confirmation; what has neither is unrestricted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.dates import whole_years
from tessera.functions.text import compact, half_up, overlap
from tessera.operators.aggregates import scored, worst

#: Levels of education, lowest first; unknown ranks lowest.
EDUCATION = ("UNKNOWN", "ASSOCIATE", "BACHELOR", "MASTER", "DOCTORATE")
#: Points for security (of 30) and for the contract (of 10) by employment; facts of the organisation and their points (fixed values).
EMPLOYMENT_POINTS = {"ESTABLISHMENT": 30, "QUOTA_OR_FILING": 27, "PUBLIC_INSTITUTION_FORMAL": 24, "UNIT_FORMAL": 22, "SOE_FORMAL": 22, "PERSONNEL_AGENCY": 18, "CONTRACT": 15, "LABOR_DISPATCH": 5, "PROJECT_BASED": 2}
CONTRACT_POINTS = {"ESTABLISHMENT": 10, "QUOTA_OR_FILING": 9, "PUBLIC_INSTITUTION_FORMAL": 8, "UNIT_FORMAL": 7, "SOE_FORMAL": 7, "PERSONNEL_AGENCY": 6, "CONTRACT": 5, "LABOR_DISPATCH": 2, "PROJECT_BASED": 0}
ORGANISATION_POINTS = {"FUNDING_STABILITY": 15, "ORGANIZATION_STABILITY": 15, "POLICY_STABILITY": 10, "BUSINESS_VOLATILITY": 10, "LAYOFF_RISK": 10}
#: Employments of the second tier, at organisations that count as public.
SECOND_TIER = ("QUOTA_OR_FILING", "PUBLIC_INSTITUTION_FORMAL", "UNIT_FORMAL", "SOE_FORMAL", "CONTRACT", "PERSONNEL_AGENCY")
SEMI_PUBLIC = ("GOVERNMENT", "PUBLIC_INSTITUTION", "STATE_OWNED_ENTERPRISE", "UNIVERSITY", "HOSPITAL", "RESEARCH_INSTITUTE")
#: Words that say that a text on gender restricts nothing, and those that only prefer (R08; fixed values).
NOT_A_RESTRICTION = ("不限", "均可", "不作要求", "无要求", "无限制")
PREFERENCE_ONLY = ("优先", "为宜", "较佳")
#: Clauses that demand membership: whole, by a phrase, or by two together; words that take it back (F31; fixed values).
PARTY_WHOLE = ("中共党员", "中共预备党员")
PARTY_PHRASES = ("限中共党员", "须为中共党员", "必须为中共党员", "要求中共党员", "政治面貌中共党员", "政治面貌为中共党员")
PARTY_TOGETHER = ("政治面貌要求", "中共党员")
PARTY_RELAXED = ("不限", "优先", "党员或", "或民主党派")
YES, MAYBE, UNSURE, CONFLICT, NO = "ELIGIBLE", "CONDITIONAL", "NEEDS_CONFIRMATION", "CONFLICTING_EVIDENCE", "INELIGIBLE"


def unparsed(text: Column) -> Column:
    """Needs confirmation if there is text that gave no restriction; unrestricted without any."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", YES).otherwise(UNSURE)


def age(earliest: Column, latest: Column, confirmed: Column, most: Column, at: Column) -> Column:
    """A birth date may be known to the month only; both of its ends must agree."""
    return F.when(most.isNull() | at.isNull() | ~confirmed, UNSURE).when(whole_years(earliest, at) <= most, YES).when(whole_years(latest, at) > most, NO).otherwise(UNSURE)


def rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, EDUCATION)), level)


def education(own: Column, confirmed: Column, least: Column, completion: Column | None = None, verification: Column | None = None) -> Column:
    """The level; then whether the record that reaches it is completed and verified."""
    settled = F.lit(YES)
    if completion is not None and verification is not None:
        settled = F.when(completion == "EXPECTED", MAYBE).when(verification.isin("PLANNED", "IN_PROGRESS"), MAYBE).when(verification == "UNKNOWN", UNSURE).otherwise(YES)
    return F.when((F.coalesce(least, F.lit("UNKNOWN")) == "UNKNOWN") | ~confirmed | (F.coalesce(own, F.lit("UNKNOWN")) == "UNKNOWN"), UNSURE).when(rank(own) < rank(least), NO).otherwise(settled)


def major(own: Column, confirmed: Column, exact: Column, text: Column) -> Column:
    """Equal in compact form, or the end of a restriction; wide categories need a person."""
    mine, asked = F.transform(own, compact), F.transform(exact, compact)
    # only what restricts is looked at major by major
    limits = F.filter(asked, lambda e: e.contains("限"))
    within = F.exists(limits, lambda e: F.exists(mine, lambda m: F.endswith(e, F.concat(F.lit("限"), m))))
    hit = F.coalesce(F.arrays_overlap(asked, mine), F.lit(False)) | within
    wide = F.exists(exact, lambda e: e.contains("门类") | e.endswith("类") | e.contains("相关专业"))
    return F.when(F.size(exact) == 0, unparsed(text)).when(~confirmed | (F.size(own) == 0), UNSURE).when(hit, YES).when(wide, UNSURE).otherwise(NO)


def graduation(year: Column, confirmed: Column, accepted: Column, text: Column) -> Column:
    """R04."""
    return F.when(F.size(accepted) == 0, unparsed(text)).when(~confirmed | year.isNull(), UNSURE).when(F.array_contains(accepted, year), YES).otherwise(NO)


def experience(years: Column, least: Column, at: Column) -> Column:
    """Years of merged intervals; null is unknown, not none."""
    return F.when(least.isNull(), UNSURE).when(least == 0, YES).when(at.isNull() | years.isNull(), UNSURE).when(years >= least, YES).otherwise(NO)


def title(own: Column, confirmed: Column, wanted: Column, text: Column) -> Column:
    """Equal, or followed by a colon."""
    hit = F.exists(wanted, lambda w: F.exists(own, lambda t: (compact(t) == compact(w)) | F.startswith(compact(t), F.concat(compact(w), F.lit("："))) | F.startswith(compact(t), F.concat(compact(w), F.lit(":")))))
    return F.when(F.size(wanted) == 0, unparsed(text)).when(~confirmed, UNSURE).when(hit, YES).otherwise(NO)


def affiliation(own: Column, confirmed: Column, required: Column) -> Column:
    """R07."""
    return F.when(~required, YES).when(~confirmed, UNSURE).when(own == "CPC_MEMBER", YES).when(own == "NON_MEMBER", NO).otherwise(UNSURE)


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def gender(own: Column, confirmed: Column, text: Column) -> Column:
    """No text, an explicit "no limit" or a preference restricts nothing; a text that names neither or both is unclear."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s、：:，,。.；;（）()]", "")
    male, female = bare.contains("男"), bare.contains("女")
    wanted = F.when(male & ~female, "MALE").when(female & ~male, "FEMALE")
    free = (bare == "") | has_any(bare, NOT_A_RESTRICTION + PREFERENCE_ONLY)
    return F.when(free, YES).when(wanted.isNull() | ~confirmed | ~F.coalesce(own, F.lit("UNKNOWN")).isin("MALE", "FEMALE"), UNSURE).when(own == wanted, YES).otherwise(NO)


def party_required(text: Column) -> Column:
    """whether a clause of the text demands membership, and neither prefers it nor offers another choice."""
    clauses = F.transform(F.split(F.coalesce(text, F.lit("")), r"[，。；;！？!?\n\r]+"), lambda c: F.regexp_replace(c, "[\\s、：:]", ""))

    def hard(c: Column) -> Column:
        together = c.contains(PARTY_TOGETHER[0]) & c.contains(PARTY_TOGETHER[1])
        return (c.isin(*PARTY_WHOLE) | has_any(c, PARTY_PHRASES) | together) & ~has_any(c, PARTY_RELAXED)

    return F.exists(clauses, hard)


#: The planner's wordings: membership preferred or free, other choices, no certificate needed, words of duty, and stages before and after the application (F32; fixed values).
PARTY_PREFERRED = ("优先", "不限")
PARTY_CHOICE = ("民主党派", "党员或", "或党员", "非中共党员", "非党员")
CERTIFICATE_NOT_NEEDED = ("无需认证", "不需认证", "不要求认证")
CERTIFICATE_DUTY = ("必须", "须", "需", "应当", "应提供", "应取得", "应完成")
CERTIFICATE_EARLY = ("报名前", "报名时", "报名截止", "资格审查前", "资格审查时", "资格审查截止", "资格初审前", "资格初审时", "材料审核前", "材料审核时")
CERTIFICATE_LATE = ("录用前", "录用时", "报到前", "报到时", "聘用前", "聘用时", "入职前", "入职时", "考察前", "考察时", "体检前", "体检时", "资格复审前", "资格复审时")


def _clauses(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"[。；;，,\r\n]+"), lambda c: F.regexp_replace(c, r"\s+", ""))


def party_rule(text: Column) -> Column:
    """F32: REQUIRED if any clause demands membership; else AMBIGUOUS if one offers a choice; else PREFERENCE; NONE if no clause speaks of it."""
    said = F.transform(F.filter(_clauses(text), lambda c: c.contains("党员")), lambda c: F.when(has_any(c, PARTY_PREFERRED), 1).when(has_any(c, PARTY_CHOICE), 2).otherwise(3))
    return F.element_at(F.array(*map(F.lit, ("NONE", "PREFERENCE", "AMBIGUOUS", "REQUIRED"))), F.coalesce(F.array_max(said), F.lit(0)) + 1)


def certificate_rule(text: Column) -> Column:
    """F32: when a foreign degree must be certified. The first clause that names a stage before the application decides (AMBIGUOUS if it names a later one, too)."""
    def kind(c: Column) -> Column:
        early, late = has_any(c, CERTIFICATE_EARLY), has_any(c, CERTIFICATE_LATE)
        return F.when(early & late, "AMBIGUOUS").when(early, "REQUIRED_BY_APPLICATION").when(late, "LATE").otherwise("UNCLEAR")

    asks = F.filter(_clauses(text), lambda c: c.contains("认证") & ~has_any(c, CERTIFICATE_NOT_NEEDED) & has_any(c, CERTIFICATE_DUTY))
    kinds = F.transform(asks, kind)
    first = F.get(F.filter(kinds, lambda k: k.isin("AMBIGUOUS", "REQUIRED_BY_APPLICATION")), F.lit(0))
    return F.coalesce(first, F.when(F.array_contains(kinds, "LATE"), "REQUIRED_LATER").when(F.size(kinds) > 0, "AMBIGUOUS").otherwise("NOT_REQUIRED"))


def fresh_graduate(state: Column, no_employer: Column, no_insurance: Column, employer: Column, insurance: Column) -> Column:
    """The worse of two declarations, if the clause asks for them; a clause that was not collected is unsure."""
    def declared(asked: Column, status: Column) -> Column:
        return F.when(~asked, YES).when(status == "DECLARED_MET", MAYBE).when(status == "DECLARED_NOT_MET", NO).otherwise(UNSURE)

    both = worst(declared(no_employer, employer), declared(no_insurance, insurance))
    return F.when(state.isNull(), UNSURE).when(state == "NOT_REQUIRED", YES).when(~no_employer & ~no_insurance, YES).when(state != "CONFIRMED", UNSURE).otherwise(both)


def unless_conflict(status: Column, conflicts: Column, field: str) -> Column:
    """Sources that contradict each other on a field decide nothing."""
    return F.when(F.array_contains(conflicts, field), CONFLICT).otherwise(status)


def fit(dimensions: dict[str, tuple[Column, int]]) -> tuple[Column, Column]:
    """Score and coverage of dimensions given as (points or null, most)."""
    return scored([p for p, _ in dimensions.values()], [m for _, m in dimensions.values()])


def overlap_points(have: Column, wanted: Column, most: int) -> Column:
    """Points for matching values, halves upwards; null if either side is empty."""
    return half_up((overlap(have, wanted) * most).cast("float"))


def mentioned_points(words: Column, text: Column, most: int) -> Column:
    """Points for the share of words that a text has, in compact form; null if either side is empty."""
    hits = F.size(F.filter(words, lambda w: F.contains(compact(text), compact(w))))
    return F.when((F.size(words) > 0) & (F.trim(text) != ""), half_up((hits * most / F.size(words)).cast("float")))


def preference(parts: list[tuple[Column, int]]) -> Column:
    """Summed points of preferences that are met; null if none was stated."""
    any_ = F.lit(False)
    total = F.lit(0)
    for met, points in parts:
        any_ = any_ | met.isNotNull()
        total = total + F.when(F.coalesce(met, F.lit(False)), points).otherwise(0)
    return F.when(any_, total)


def stability_points(employment: Column, facts: list[tuple[Column, int]]) -> list[Column]:
    """Points for employment (of 30), for facts of the organisation as shares of their points, and for the contract (of 10); null if unknown."""
    def points(table: dict[str, int]) -> Column:
        return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[employment]

    return [points(EMPLOYMENT_POINTS), *(half_up((v * m).cast("float")) for v, m in facts), points(CONTRACT_POINTS)]


def stability(employment: Column, facts: list[tuple[Column, int]]) -> tuple[Column, Column]:
    """Score and coverage; what is unknown lowers coverage."""
    return scored(stability_points(employment, facts), [30, *(m for _, m in facts), 10])


def tier(employment: Column, organisation: Column, evidenced: Column) -> Column:
    """Nothing without evidence; the second tier at public organisations only."""
    return F.when(evidenced & (employment == "ESTABLISHMENT"), "T1").when(evidenced & employment.isin(*SECOND_TIER) & organisation.isin(*SEMI_PUBLIC), "T2").otherwise("T3")


def decision(status: Column, tier_: Column, fit_: Column, coverage: Column) -> tuple[Column, Column]:
    """Ineligible records are excluded; recommended if eligible, covered by half, not in the last tier and fit."""
    final = F.when(status == NO, "EXCLUDED").otherwise(tier_)
    return final, (status == YES) & (coverage >= 50) & (final != "T3") & (fit_ >= 60)


def cohort(target: Column, explicit: Column) -> Column:
    """Accepted years; explicit ones if they follow each other and lie at most two before the target, else null."""
    years = F.array_sort(F.array_distinct(explicit))
    first, last = F.get(years, F.lit(0)), F.element_at(years, -1)
    fine = (F.size(years) == last - first + 1) & (last <= target) & (first >= target - 2)
    return F.when(F.size(years) > 0, F.when(fine, years))


def digest_reason(change: Column, days: Column, window: int = 7) -> Column:
    """Why a record is in the digest; null if it is not."""
    return F.when(change.isin("NEW", "UPDATED", "DEACTIVATED"), change).when(days <= window, "DEADLINE_APPROACHING")


def review_reasons(fields: dict[str, tuple[Column, Column]], least: float = 0.90) -> Column:
    """For each field (status, confidence): not explicit, or not sure enough; the reasons, in order."""
    return F.array_compact(F.array(*(F.when(status == "UNKNOWN", F.lit(f"{name}:MISSING")).when(status == "INTERPRETED", F.lit(f"{name}:INTERPRETED")).when(confidence < least, F.lit(f"{name}:LOW_CONFIDENCE")) for name, (status, confidence) in fields.items())))


def legacy_status(criteria: list[Column]) -> Column:
    """FAIL, UNKNOWN, CONDITIONAL, PASS, in this order; criteria that do not apply are null."""
    out = F.lit("PASS")
    for s in ("CONDITIONAL", "UNKNOWN", "FAIL"):
        hit = F.lit(False)
        for c in criteria:
            hit = hit | F.coalesce(c == s, F.lit(False))
        out = F.when(hit, s).otherwise(out)
    return out


def graduate_track(expected: Column, confirmed: Column, target: int) -> Column:
    """The track of the target year, by the year that a master's degree is expected in."""
    return F.when(~confirmed | expected.isNull(), "UNKNOWN").when(expected == target, "TARGET_YEAR_GRADUATE").when(expected.between(target - 2, target - 1), "RECENT_GRADUATE_WINDOW").otherwise("NOT_IN_GRADUATE_SCOPE")


def graduate_projection(graduated: str, historical: Column, target: int) -> tuple[Column, Column]:
    """Track and outcome of a graduate under a rule, in the year of the notice or, its cohorts shifted, in the target year.

    Columns: state, year, years (none: unrestricted), abroad, no_employer, no_insurance of the rule; foreign_degree, worked, sure
    (records confirmed), pending (degree or its certificate still to come) of the graduate.
    """
    own, free = F.col(graduated), F.size("years") == 0
    accepted = F.when(historical, F.col("years")).otherwise(F.transform("years", lambda y: y + target - F.col("year")))
    at = F.when(historical, F.col("year")).otherwise(F.lit(target))
    unknown = (F.col("state") != "CONFIRMED") | own.isNull()
    outside = ~free & ~F.array_contains(accepted, own)
    abroad = F.col("foreign_degree") & ~F.col("abroad")
    bound = (F.col("worked") & F.col("no_employer")) | F.col("no_insurance")
    plain = F.when(free, "UNRESTRICTED").when(own == at, "TARGET_YEAR_GRADUATE").otherwise("RECENT_GRADUATE_WINDOW")
    track = F.when(unknown, "UNKNOWN").when(outside, "NOT_IN_GRADUATE_SCOPE").when(abroad, plain).when(bound | ~F.col("sure"), "CONDITIONAL").otherwise(plain)
    outcome = F.when(unknown, "UNCERTAIN").when(outside | abroad, "INELIGIBLE").when(bound, "CONDITIONALLY_ELIGIBLE").when(~F.col("sure"), "UNCERTAIN").when(F.col("pending"), "CONDITIONALLY_ELIGIBLE").otherwise("ELIGIBLE")
    return track, outcome
