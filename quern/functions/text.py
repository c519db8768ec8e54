"""Text functions as Column expressions. Where Spark has no equivalent a pandas UDF stands in, and says so."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from quern.sources.batches import small_batches

# Patterns. Java's classes are ASCII unless (?U) is given.
TOKEN = "[A-Za-z0-9_]+|[\u4e00-\u9fff]"
ZERO_WIDTH = "[\u200b-\u200f\u2060\ufeff]"
REPEATED = "(?d)(.)\\1{49,}"
#: Kinds of sensitive text in the order of their removal: name, pattern, what takes its place.
SENSITIVE = (
    ("email", "(?iU)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b", "[已遮盖邮箱]"),
    ("phone", "(?U)(?<!\\d)(?:\\+?86[- ]?)?1[3-9]\\d{9}(?!\\d)", "[已遮盖手机号]"),
    ("national_id", "(?U)(?<!\\d)\\d{17}[\\dXx](?![\\dXx])", "[已遮盖证件号]"),
    ("precise_coordinate", "(?iU)(?:lat(?:itude)?|lon(?:gitude)?|纬度|经度)\\s*[:：=]?\\s*[-+]?\\d{1,3}(?:\\.\\d+)?", "[已遮盖精确坐标]"),
)

#: What a text must hold for a pattern to fit, and is quicker to look for; an email needs an @.
NEEDED = {"phone": "1[3-9]\\d{9}|[^\\x00-\\x7f]", "national_id": "\\d{17}|[^\\x00-\\x7f]", "precise_coordinate": "\\d|[^\\x00-\\x7f]"}

# The word lists of the surface features.
LEXICON = {
    "urgency": ("立即", "马上", "快", "救命", "昏迷", "呼吸", "着火", "浓烟", "被困"),
    "context": ("家", "室内", "室外", "楼", "路", "地点", "附近", "孩子", "老人", "伤者", "患者"),
    "hazard": ("火", "烟", "洪水", "积水", "地震", "中毒", "触电", "受伤", "雷", "暴雨", "高温", "结冰"),
    "negation": ("不", "没", "无", "不要", "不能", "禁止", "避免"),
    "connector": ("并且", "同时", "还", "另外", "然后", "以及"),
    "generic": ("怎么办", "怎么办？", "怎么处理", "怎么处理？", "现在怎么办", "现在怎么办？", "救命"),
}
#: Negations that turn an instruction around, and those that mark a clause as negative.
TURNS = ("不", "不得", "不要", "禁止", "避免", "切勿", "不可", "不能")
NEGATIVE = ("不得", "不要", "禁止", "避免", "切勿", "不可", "不能")
#: Single characters that make a short text meaningful.
SHORT_CUES = "水血喘呼吸火烟困冷热痛伤震洪电网救命求救昏晕出血被困胸"
#: Fixed value: what a second search step adds to the query.
SECOND_STEP = " 应急 现场安全 撤离 急救 官方指引"


def tokens(text: Column) -> Column:
    """Lower-case tokens in order: runs of ASCII word characters, or single CJK characters."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.lower(x))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)\\s+", "")


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has none."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize_text(text: Column) -> Column:
    """Composed, with line feeds alone, no zero-width characters, single spaces, trimmed lines, one blank line at most."""
    small_batches()
    # ASCII is composed as it is and stays in the JVM
    other = F.when(F.octet_length(text) != F.length(text), text)
    return _tidy(F.coalesce(nfkc(other), text))


@pandas_udf(ArrayType(StringType()))
def nfkc_all(texts: pd.Series) -> pd.Series:
    """Compatibility composition of an array's texts; a Python function cannot stand inside transform."""
    return texts.map(lambda ts: ts if ts is None else [t if t is None else unicodedata.normalize("NFKC", t) for t in ts])


def normalize_all(texts: Column) -> Column:
    small_batches()
    return F.transform(nfkc_all(texts), _tidy)


def _tidy(text: Column) -> Column:
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, ZERO_WIDTH, "")
    t = F.regexp_replace(t, "(?U)[^\\S\r\n]+", " ")
    t = F.array_join(F.transform(F.split(t, "\n", -1), lambda x: strip(x)), "\n")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def redact(text: Column) -> Column:
    """struct(text, kinds): each pattern sees what the earlier ones left.

    A step is bound before the next one reads it, so that each pattern runs over a text once, and twice where it fits; where a needed part is missing it does not run.
    """
    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    for kind in SENSITIVE:
        state = F.element_at(F.transform(F.array(state), _redaction(*kind)), 1)
    return state


def _redaction(name: str, pattern: str, instead: str):
    """A step from struct(text, kinds) to the next."""

    def step(s: Column) -> Column:
        needed = F.contains(s["text"], F.lit("@")) if name == "email" else F.regexp_like(s["text"], F.lit(NEEDED[name]))
        fits = needed & F.regexp_like(s["text"], F.lit(pattern))
        return F.when(fits, F.struct(F.regexp_replace(s["text"], pattern, instead).alias("text"), F.concat(s["kinds"], F.array(F.lit(name))).alias("kinds"))).otherwise(s)

    return step


def present(text: Column, terms) -> Column:
    """How many of the terms occur."""
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def occurrences(text: Column, terms) -> Column:
    """How often the terms occur, each one's non-overlapping occurrences; terms inside others count again."""
    return sum((((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)).cast("int") for t in terms), F.lit(0))


def surface_features(text: Column, lexicon: dict = LEXICON) -> dict[str, Column]:
    """The ten features of a query's text, all doubles."""
    small = compact(F.lower(text))
    found = {
        "token_count": F.size(tokens(text)),
        "character_count": F.length(small),
        "has_question_mark": F.contains(text, F.lit("?")) | F.contains(text, F.lit("？")),
        "urgency_term_count": present(small, lexicon["urgency"]),
        "hazard_term_count": present(small, lexicon["hazard"]),
        "context_term_count": present(small, lexicon["context"]),
        "negation_count": occurrences(small, lexicon["negation"]),
        "multi_intent_connector_count": occurrences(small, lexicon["connector"]),
        "has_numeric_detail": F.regexp_like(small, F.lit("(?U)\\d")),
        "surface_insufficient_information": small.isin(*lexicon["generic"]) | (F.length(small) < 6),
    }
    return {k: v.cast("int").cast("double") for k, v in found.items()}


def score_features(scores: Column) -> dict[str, Column]:
    """Top score, margin and entropy of a ranked list's scores; negative scores count as 0."""
    s = F.transform(scores, lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    top = F.coalesce(F.get(s, F.lit(0)), F.lit(0.0))
    entropy = F.aggregate(F.filter(s, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x / total * F.ln(x / total))
    return {"retrieval_top_score": top, "retrieval_margin": top - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0)), "retrieval_entropy": entropy}


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters without white space; a single character stands for itself."""
    t = compact(text)
    pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    return F.array_distinct(F.when(F.length(t) >= 2, pairs).when(F.length(t) == 1, F.array(t)).otherwise(F.array().cast("array<string>")))


def action_matched(action: Column, answer: Column, share: float = 0.55) -> Column:
    """Whether the answer holds the action, or at least `share` of its bigrams."""
    return prepared_match(compact(action), bigrams(action), compact(answer), bigrams(answer), share)


def prepared_match(action: Column, wanted: Column, answer: Column, held: Column, share: float = 0.55) -> Column:
    """action_matched over compact texts and their bigrams, which a join of many pairs makes once for each row."""
    part = F.size(F.array_intersect(wanted, held)) / F.greatest(F.size(wanted), F.lit(1))
    return F.contains(answer, action) | ((F.size(wanted) > 0) & (part >= share))


def positive_instruction(action: Column, answer: Column, back: int = 8) -> Column:
    """Whether the answer's first mention of the action has no negation in the characters before it."""
    a = compact(answer)
    at = F.instr(a, compact(action))
    before = F.substring(a, F.greatest(at - back, F.lit(1)), F.least(at - 1, F.lit(back)))
    return (at > 0) & ~F.regexp_like(before, F.lit("|".join(TURNS)))


def text_variant(text: Column, copy: Column) -> Column:
    """A spelling with other punctuation: full-width for the first copy, ASCII for later ones."""
    wide = F.translate(text, "?,;:", "？，；：")
    ended = F.when(F.endswith(text, F.lit("。")), F.substring(text, F.lit(1), F.length(text) - 1)).when(F.regexp_like(text, F.lit("[？！。]$")), text).otherwise(F.concat(text, F.lit("？")))
    return F.when(copy == 1, F.when(wide == text, ended).otherwise(wide)).otherwise(F.translate(text, "？，；：", "?,;:"))


def hash_fraction(seed: int, value: Column) -> Column:
    """The first 64 bits of SHA-256 over "seed:value" as a number from 0 to 1."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), value), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / 2.0**64


def clauses(text: Column) -> Column:
    """Clauses without white space, of at least 4 characters: (clause, negative, tokens)."""
    parts = F.filter(F.transform(F.split(text, "[。！？；\n]+"), lambda x: compact(x)), lambda x: F.length(x) >= 4)
    return F.transform(parts, lambda x: F.struct(x.alias("clause"), F.regexp_like(x, F.lit("|".join(NEGATIVE))).alias("negative"), F.array_distinct(tokens(x)).alias("tokens")))
