"""Column functions on text: normal forms, identities, parsed requirements, classifications.

All but `nfkc` are built-in expressions, so they stay in generated code and can be pushed down.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters between words of a requirement that do not matter.
SEPARATORS = r"[\s·（）()_-]"
#: Query parameters that do not change what a page shows.
TRACKING = ("from", "spm", "source", "ref")
#: Dates and years of experience in text, and the wordings of age limits: range, exclusive bounds, upper bounds, bare number (F20, F21; fixed values).
DATE = r"(?<!\d)\d{4}(?:\s*年(?:\s*\d{1,2}\s*月(?:\s*\d{1,2}\s*日)?)?|[-/.]\d{1,2}(?:[-/.]\d{1,2})?)"
AGE_RANGE = r"^(\d{1,3})\s*(?:周岁|岁)?\s*(?:至|到|[-—~～－])\s*(\d{1,3})\s*(?:周)?岁$"
AGE_EXCLUSIVE = r"(?:未满|不满)\s*(\d{1,3})\s*(?:周)?岁|(\d{1,3})\s*(?:周)?岁\s*[（(]不含[）)]\s*以下"
AGE_UPPER = r"(?:不超过|不得超过|最高|最大)\s*(\d{1,3})\s*(?:周)?岁|(\d{1,3})\s*(?:周)?岁\s*(?:及)?(?:以下|以内)"
AGE_BARE = r"^(\d{1,3})\s*(?:周)?岁$"
YEARS = r"(?<!\d)(\d{1,2})\s*年(?!制)"
YEARS_ALONE = r"^\d{1,2}\s*年(?:及以上|以上)?$"
#: Words that make a limit conditional, clauses that ask for no experience, and clauses that ask for some (F20, F21; fixed values).
AGE_CONDITIONAL = "博士|硕士|本科|职称|放宽|非|不低于|不少于|不限"
YEARS_CONDITIONAL = "不超过|不要求|以内|以下|至多|最多|博士|硕士|本科|应届|优先|不限于"
YEARS_NONE = r"^(?:(?:工作)?(?:经历|经验|年限)(?:要求)?[:：]?)?(?:不限|无要求|不作要求|不做要求|无限制)$|^无(?:工作)?(?:经历|经验|年限)要求$"
YEARS_CLAUSE = "经验|经历|年限|[零〇一二三四五六七八九十百两]+年(?!制)"
#: Stages of a campaign by words of its notices, in the order of the process (F28; fixed values).
STAGES = (
    ("QUALIFICATION_REVIEW", "资格复审|资格审查|资格确认"),
    ("WRITTEN_EXAM", "笔试(?!成绩|结果|分数)|专业知识测试|考试安排|实践技能测试"),
    ("SCORE_RESULT", "笔试成绩|总成绩|综合成绩|考试成绩|成绩公告|成绩查询|入围面试|入围体检"),
    ("INTERVIEW", "面试"),
    ("PHYSICAL_EXAM", "体检"),
    ("INVESTIGATION", "考察|政审"),
    ("PUBLICATION", "拟聘|公示"),
    ("APPOINTMENT", "办理聘用|正式聘用|录用通知|聘用手续|录用手续"),
)


def compact(text: Column) -> Column:
    """Trimmed, lower-cased, without separators."""
    return F.regexp_replace(F.lower(F.trim(text)), SEPARATORS, "")


def identity_form(text: Column) -> Column:
    """Lower-cased, without punctuation and white space of any kind."""
    return F.regexp_replace(F.lower(text), r"[\p{P}\p{Z}\s]", "")


def content_form(text: Column) -> Column:
    """Trimmed, each stretch of white space as one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode normal form KC, lower-cased, without punctuation and spaces; Spark has no built-in for it."""
    import unicodedata

    def form(text: str | None) -> str | None:
        if text is None:
            return None
        plain = unicodedata.normalize("NFKC", text).lower()
        return "".join(c for c in plain if unicodedata.category(c)[0] not in "PZ" and not c.isspace())

    for series in values:
        yield series.map(form)


def fingerprint(*fields: Column) -> Column:
    """SHA-256 over fields with their lengths, so that no two lists of values run together; null differs from empty.

    Arrays count as sets: their order does not matter. Equality is what is meant, not particular bytes.
    """
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def set_text(values: Column) -> Column:
    """A set as one text: sorted, each value with its length."""
    return F.concat_ws(";", F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.concat(F.length(v).cast("string"), F.lit(":"), v)))


def stable_key(*parts: Column) -> Column:
    """The identity of a record by its source, owner and code or title."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def name_uuid(text: Column) -> Column:
    """The name-based UUID (version 3) of a text."""
    h = F.md5(text)
    high = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(high, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def canonical_uri(uri: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment or tracking parameters, parameters sorted, dot segments resolved, "/" for no path.

    Null unless the address is absolute and has a host.
    """
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    user = F.regexp_extract(authority, r"^(.*@)", 1)
    place = F.lower(F.regexp_replace(authority, r"^.*@", ""))
    port = F.regexp_extract(place, r":(\d+)$", 1)
    default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    place = F.when(default, F.regexp_replace(place, r":\d+$", "")).otherwise(place)
    path = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    segments = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when((s == "..") & (F.size(done) > 1), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, s)),
    )
    resolved = F.when(path.contains("/."), F.concat(F.array_join(segments, "/"), F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))).otherwise(path)
    query = F.regexp_extract(uri, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (F.trim(p) != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING) & ~F.lower(p).startswith("utm_"))
    params = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(scheme, F.lit("://"), user, place, resolved, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(F.lit("")))
    return F.when((scheme != "") & (place != ""), whole)


def query_parameter(uri: Column, name: str) -> Column:
    """The value of a query parameter, decoded, lower-cased."""
    return F.lower(F.url_decode(F.nullif(F.regexp_extract(uri, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))))


def _undated(text: Column) -> Column:
    """A text without its dates, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), DATE, " "))


def _numbers(text: Column, pattern: str, groups: int = 1) -> Column:
    """Distinct numbers that any of the groups of a pattern's matches holds."""
    every = F.concat(*(F.regexp_extract_all(text, F.lit(pattern), i) for i in range(1, groups + 1)))
    return F.array_distinct(F.transform(F.filter(every, lambda x: x != ""), lambda x: x.cast("int")))


def age_limit(text: Column) -> Column:
    """The one age limit of a text: a range's upper end, an exclusive bound less one, an upper bound or a bare number.

    Null if the text has none, several, a conditional one, or one outside 16 to 70; dates are no ages (F20).
    """
    raw = _undated(text)

    def plausible(age: Column) -> Column:
        return F.when(age.between(16, 70), age)

    low, high, bare = (F.nullif(F.regexp_extract(raw, p, i), F.lit("")).cast("int") for p, i in ((AGE_RANGE, 1), (AGE_RANGE, 2), (AGE_BARE, 1)))
    bounds = F.array_union(F.transform(_numbers(raw, AGE_EXCLUSIVE, 2), lambda x: x - 1), _numbers(raw, AGE_UPPER, 2))
    ranged = F.when((low <= high) & plausible(low).isNotNull(), plausible(high))
    one = F.when(F.size(bounds) == 1, plausible(F.get(bounds, F.lit(0)))).when(F.size(bounds) == 0, plausible(bare))
    return F.when(raw.rlike(AGE_CONDITIONAL), F.lit(None).cast("int")).when(high.isNotNull(), ranged).otherwise(one)


def experience_years(text: Column) -> Column:
    """The one number of years asked for, at most 50; 0 if a clause says that none are and no other asks; null if conditional or unclear."""
    raw = _undated(text)
    years = _numbers(raw, YEARS)
    clauses = F.transform(F.split(raw, r"[，,；;。\n]"), lambda c: F.regexp_replace(c, r"\s+", ""))
    none = F.exists(clauses, lambda c: c.rlike(YEARS_NONE))
    some = F.exists(clauses, lambda c: ~c.rlike(YEARS_NONE) & c.rlike(YEARS_CLAUSE))
    one = F.get(years, F.lit(0))
    named = raw.rlike("工作|经验|经历") | raw.rlike(YEARS_ALONE)
    return F.when(none, F.when((F.size(years) == 0) & ~some, 0)).when(~raw.rlike(YEARS_CONDITIONAL) & (F.size(years) == 1) & named & (one <= 50), one)


def classify(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first rule whose pattern the text has; rules: (label, pattern) in order."""
    out = F.lit(otherwise)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def labels(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The labels of all rules whose pattern the text has, in order."""
    return F.array_compact(F.array(*(F.when(text.rlike(pattern), F.lit(label)) for label, pattern in rules)))


def campaign_stem(title: Column, noise: str, cut: str, least: int = 8) -> Column:
    """A title without noise words, up to the first marker of a stage, compact; null if shorter than `least`."""
    bare = F.regexp_replace(F.lower(title), noise, "")
    at = F.regexp_instr(bare, F.lit(cut))
    stem = identity_form(F.when(at > 0, F.substring(bare, F.lit(1), at - 1)).otherwise(bare))
    return F.when(F.length(stem) >= least, stem)


def split_list(text: Column) -> Column:
    """Items of a list in text; of an item that names a restriction in brackets, the restriction; trailing brackets go."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), r"[、,，;；/\n]"), lambda s: F.trim(s))
    items = F.transform(items, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^.*[（(]限", ""), r"[）)]$", ""), "方向$", "")))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def years_in(text: Column) -> Column:
    """Distinct years 20xx that a text names, in ascending order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(20\d{2})"), 1), lambda x: x.cast("int"))))


def requirement(text: Column, asked: str, relaxed: str) -> Column:
    """Whether some clause of a text asks for something and does not relax it in the same clause."""
    return F.coalesce(F.exists(F.split(text, "[。；;，,]"), lambda c: c.rlike(asked) & ~c.rlike(relaxed)), F.lit(False))


def keyword_score(text: Column, weights: dict[str, float], most: float = 0.99) -> Column:
    """The summed weights of the words that a text has, at most `most`, to two places, half up."""
    total = F.lit(0).cast("decimal(10,4)")
    for word, weight in weights.items():
        total = total + F.when(text.contains(word), F.lit(weight).cast("decimal(10,4)")).otherwise(F.lit(0).cast("decimal(10,4)"))
    return F.round(F.least(total, F.lit(most).cast("decimal(14,4)")), 2)


def overlap(have: Column, wanted: Column) -> Column:
    """The share of the wanted values that are there, compared in compact form; null if either side is empty."""
    own = F.transform(have, compact)
    hits = F.size(F.filter(wanted, lambda w: F.array_contains(own, compact(w))))
    return F.when((F.size(have) > 0) & (F.size(wanted) > 0), hits / F.size(wanted))


def half_up(value: Column) -> Column:
    """To the nearest whole number, halves upwards."""
    return F.floor(value.cast("double") + 0.5).cast("long")


def yes_no(text: Column, yes: list[str], no: list[str]) -> Column:
    """True, false or unknown."""
    return F.when(F.trim(text).isin(yes), True).when(F.trim(text).isin(no), False)


def supports(value: Column, text: Column) -> Column:
    """Whether a text bears a value out: as it is, or, for a number, not as part of a longer one."""
    number = value.rlike(r"^\d+$")
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    alone = F.regexp_like(padded, F.concat(F.lit(r"[^0-9]"), value, F.lit(r"[^0-9]")))
    return F.coalesce(F.when(number, alone).otherwise(F.contains(text, value)), F.lit(False))


def ordinal(text: Column) -> Column:
    """The number of a reference such as "第3个", in Arabic, full-width or Chinese digits up to 99; null if there is none."""
    plain = F.translate(text, "０１２３４５６７８９", "0123456789")
    digits = F.nullif(F.regexp_extract(plain, r"第\s*(\d{1,2})\s*[个条项]", 1), F.lit("")).cast("int")
    words = F.translate(F.regexp_extract(plain, r"第\s*([一二三四五六七八九十两]{1,3})\s*[个条项]", 1), "一二三四五六七八九两", "1234567892")
    tens = F.regexp_extract(words, "^([1-9]?)十", 1)
    ones = F.regexp_extract(words, "([1-9]?)$", 1)
    spelt = F.when(words.contains("十"), F.coalesce(F.nullif(tens, F.lit("")).cast("int"), F.lit(1)) * 10 + F.coalesce(F.nullif(ones, F.lit("")).cast("int"), F.lit(0))).otherwise(F.nullif(words, F.lit("")).try_cast("int"))
    return F.coalesce(digits, F.when(words != "", spelt))


def says_without_disclaimer(text: Column, claim: str, disclaimer: str, window: int = 12) -> Column:
    """Whether some clause makes a claim that no disclaimer stands before, within so many characters."""
    return F.coalesce(F.exists(F.split(text, "[。！？!?；;]"), lambda c: c.rlike(claim) & ~c.rlike(f"(?:{disclaimer}).{{0,{window}}}(?:{claim})")), F.lit(False))
