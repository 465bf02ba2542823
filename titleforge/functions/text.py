"""Text expressions: cleaning, the keyword rule, prompts, and responses of scorers.

All are Column -> Column and stay in generated code; only `parse_response_exact` runs in Python."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space that Python's str.strip removes.
WHITE = r"\t-\r\x1c-\x20\u0085   -     　"
LABELS = ("Yes", "No")
RESPONSE = T.StructType([T.StructField("label", T.StringType()), T.StructField("explanation", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("format_valid", T.BooleanType())])


def strip(text: Column) -> Column:
    """Without Unicode white space at either end; null stays null."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def replace_surrogates(text: Column) -> Column:
    """Invalid UTF-8 (such as lone surrogates) as U+FFFD."""
    return F.make_valid_utf8(text)


@dataclass(frozen=True)
class KeywordRule:
    """An ordered cascade of patterns; the defaults are the fixed values of the Chinese title rule."""

    negative: str = "辟谣|别信|勿信|莫信|不靠谱|骗局|警惕|提醒|误区|新闻|实录|指南|科普"
    question: str = "[?？]"
    question_override: str = "根治|专治|永不复发|神效"
    high_risk: str = "根治|断根|永不复发|神效|奇效|特效|百试百灵|一招见效|立竿见影|秘方|祖传|包治|专治|不用吃药|不吃药|不用手术|不用化疗|嗖嗖"
    remedy: str = "偏方|食疗|药膳|保健品|补充剂"
    claim: str = "治疗|治愈|降血压|降血糖|降血脂|降尿酸|抗癌|排毒|清血管|提高免疫力|增强免疫力"

    def score(self, text: Column) -> Column:
        """Probability of Yes: 0.10, 0.25, 0.90, 0.75 or 0.30; null text scores as the text `nan` would, 0.30."""
        t = F.coalesce(text, F.lit(""))
        return (
            F.when(t.rlike(self.negative), 0.10)
            .when(t.rlike(self.question) & ~t.rlike(self.question_override), 0.25)
            .when(t.rlike(self.high_risk), 0.90)
            .when(t.rlike(self.remedy) & t.rlike(self.claim), 0.75)
            .otherwise(0.30)
        )

    def predict(self, text: Column) -> Column:
        """struct(label, score)."""
        s = self.score(text)
        return F.struct(F.when(s >= 0.5, "Yes").otherwise("No").alias("label"), s.alias("score"))


def user_prompt(title: Column) -> Column:
    """The prompt that shows a scorer the title and nothing else."""
    return F.concat(F.lit("Article title: "), replace_surrogates(title), F.lit("\nJudge the title now and return JSON only."))


def messages(system: Column, user: Column) -> Column:
    """The two messages of a request: array of struct(role, content)."""
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def strip_fence(text: Column) -> Column:
    """Without white space around it and without the marks of a code fence."""
    opened = F.regexp_replace(strip(text), f"(?i)^```(?:json)?[{WHITE}]*", "")
    return F.regexp_replace(opened, f"[{WHITE}]*```$", "")


def outer_object(text: Column) -> Column:
    """From the first { to the last }, or the empty text."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def rescue_label(text: Column) -> Column:
    """The first yes or no that stands as a word of its own, as Yes or No, else the empty text."""
    found = F.lower(F.regexp_extract(text, r"(?i)(^|[^\p{L}\p{N}_])(yes|no)($|[^\p{L}\p{N}_])", 2))
    return F.when(found == "yes", "Yes").when(found == "no", "No").otherwise("")


def clamp_confidence(text: Column) -> Column:
    """A number as text, held between 0 and 1; NaN is 0; null where it is no number."""
    value = text.try_cast("double")
    return F.when(F.isnan(value), 0.0).when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def _balanced(body: Column) -> Column:
    """Whether the text is one object: nothing stays when its innermost braces are taken out again and again."""
    bare = F.regexp_replace(body, r'"(?:[^"\\]|\\.)*"', "")
    for _ in range(4):
        bare = F.regexp_replace(bare, r"\{[^{}]*\}", "")
    return bare == ""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def parse_response(raw: Column) -> Column:
    """struct(label, explanation, confidence, format_valid) of a response, by built-in functions.

    The outer object is read as JSON of at most four levels. Without a legal label in it, or if its
    confidence is no number, the first yes or no of the whole text is taken, with confidence 0.5, its
    first 200 characters as explanation, and format_valid false. Null gives the empty label."""
    text = strip_fence(F.coalesce(raw, F.lit("")))

    def read(t: Column) -> Column:
        body = outer_object(t)
        fields = F.from_json(body, "label string, explanation string, confidence string", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
        return F.struct(t.alias("t"), fields.alias("f"), F.try_parse_json(body).alias("v"), _balanced(body).alias("whole"))

    def judge(r: Column) -> Column:
        named = F.lower(strip(r["f"]["label"]))
        kind = F.try_variant_get(r["v"], "$.confidence", "string")
        given = F.when(kind == "true", 1.0).when(kind == "false", 0.0).otherwise(clamp_confidence(strip(r["f"]["confidence"])))
        absent = F.try_variant_get(r["v"], "$.confidence", "variant").isNull()
        return F.struct(
            r["t"].alias("t"), r["f"]["explanation"].alias("e"), F.when(r["v"].isNotNull() & r["whole"], F.when(named == "yes", "Yes").when(named == "no", "No")).alias("label"),
            F.when(absent, 0.5).otherwise(given).alias("confidence"),
        )

    def settle(r: Column) -> Column:
        ok = r["label"].isNotNull() & r["confidence"].isNotNull()
        return F.struct(
            F.when(ok, r["label"]).otherwise(rescue_label(r["t"])).alias("label"),
            F.when(ok, strip(F.coalesce(r["e"], F.lit("")))).otherwise(F.substring(r["t"], 1, 200)).alias("explanation"),
            F.when(ok, r["confidence"]).otherwise(0.5).alias("confidence"),
            ok.alias("format_valid"),
        )

    return let(let(let(text, read), judge), settle)


_FENCE = re.compile(r"(?:\A```(?:json)?\s*)?(.*?)(?:\s*```)?\Z", re.IGNORECASE | re.DOTALL)
_WORD = re.compile(r"\b(?:yes|no)\b", re.IGNORECASE)


def _object(body: str) -> tuple[str, str, float] | None:
    """(label, explanation, confidence) of the outer object of a text; None without a legal label or a number."""
    try:
        fields = json.loads(body[body.index("{") : body.rindex("}") + 1])
        label, confidence = str(fields.get("label", "")).strip().lower(), float(fields.get("confidence", 0.5))
    except (ValueError, TypeError, AttributeError):
        return None
    legal = {x.lower(): x for x in LABELS}
    held = 0.0 if math.isnan(confidence) else min(1.0, max(0.0, confidence))
    return (legal[label], str(fields.get("explanation", "")).strip(), held) if label in legal else None


def read_response(raw: str | None) -> tuple[str, str, float, bool]:
    """(label, explanation, confidence, format_valid) of one response, by the rules of a strict JSON parser."""
    bare = _FENCE.match((raw or "").strip())[1]  # type: ignore[index]  it matches any text
    if found := _object(bare):
        return *found, True
    word = _WORD.search(bare)
    return word[0].capitalize() if word else "", bare[:200], 0.5, False


@F.pandas_udf(RESPONSE)  # type: ignore[call-overload]
def parse_response_exact(raw: pd.Series) -> pd.DataFrame:
    """As `parse_response`, with the rules of a strict JSON parser in every corner, over Arrow batches."""
    return pd.DataFrame([read_response(x) for x in raw], columns=["label", "explanation", "confidence", "format_valid"])


def ngram_text(text: Column) -> Column:
    """A text as n-grams are cut from it: lower case, runs of white space as one blank; null is the empty text."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WHITE}][{WHITE}]+", " "))


def char_ngrams(text: Column, sizes: Sequence[int] = (2, 3, 4, 5)) -> Column:
    """All character n-grams of a text in lower case, runs of white space as one blank; null and short texts have none."""
    t = ngram_text(text)
    n = F.length(t)

    def grams(size: int) -> Column:
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(t, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*(grams(s) for s in sizes)))
