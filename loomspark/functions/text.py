"""Scalar text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points at which words are split (Unicode white space and U+001C-U+001F).
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# The code points at which lines are split.
LINE = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
PREFIX = 200


def normalize(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the normalized text."""
    return F.sha2(normalize(text), 256)


def token_count(text: Column) -> Column:
    """Words of the normalized text."""
    n = normalize(text)
    return F.when(n == "", 0).otherwise(F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) + 1).cast("long")


def prefix(text: Column, chars: int = PREFIX) -> Column:
    return F.substring(text, 1, chars)


def snippet(text: Column, chars: int = PREFIX) -> Column:
    n = normalize(text)
    return F.when(F.length(n) > chars, F.concat(F.substring(n, 1, chars), F.lit("..."))).otherwise(n)


def prompt(template: str, text: Column, grading: str, filter_name: str) -> Column:
    """The filter's template with the document put in, a newline, and the grading text."""
    return F.concat(F.replace(F.lit(template), F.lit("{document}"), text), F.lit("\n" + grading.replace("{trait}", filter_name.replace("_", " "))))


def message_text(content: Column) -> Column:
    """Text of a chat message's VARIANT content: a string, or a list of strings and {text} or {content} objects.

    Parts are joined by a newline; anything else is left out.
    """

    def string(v: Column, path: str = "$") -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))

    def part(v: Column) -> Column:
        first = F.schema_of_variant(F.try_variant_get(v, "$.text", "variant"))
        empty = first.isNull() | (first == "VOID") | (string(v, "$.text") == "")
        return F.coalesce(string(v), F.when(F.coalesce(empty, F.lit(False)), string(v, "$.content")).otherwise(string(v, "$.text")))

    parts = F.try_variant_get(content, "$", "array<variant>")
    return F.coalesce(string(content), F.array_join(F.transform(parts, part), "\n"), F.lit(""))


def payload(model: Column, text: Column, system: str, max_tokens: int, effort: str) -> Column:
    """A chat request as JSON: a system message, the prompt, the output limit and the reasoning options."""
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), text.alias("content")),
    )
    reasoning = F.struct(F.lit(True).alias("enabled"), F.lit(effort).alias("effort"), F.lit(True).alias("exclude"))
    return F.to_json(F.struct(model.alias("model"), messages.alias("messages"), F.lit(max_tokens).alias("max_tokens"), reasoning.alias("reasoning")))


_SOME = SPACE[:-1] + "*"
# What may stand in an answer's tags.
_NUMBER = "(10|[0-9])"


def _last_of(body: Column, *patterns: str) -> Column:
    """The last match of the first pattern that matches at all."""
    return F.coalesce(*(F.try_element_at(F.regexp_extract_all(body, F.lit("(?is)" + p), F.lit(1)), F.lit(-1)) for p in patterns))


def _tagged(body: Column, tag: str, others: str) -> Column:
    """Content between a tag and its end; without any such, up to any end tag, another tag, or the end of the text."""
    whole = f"<{tag}>((?:(?!<{tag}>).)*?)</{tag}>"
    damaged = rf"<{tag}>{_SOME}(.*?){_SOME}(?:</[\p{{L}}\p{{N}}_]+>|(?=<(?:{others})(?![\p{{L}}\p{{N}}_]))|\z)"
    return _last_of(body, whole, damaged)


def parse_response(body: Column) -> Column:
    """struct(rating, explanation, quote) of a judge's answer; null without a rating from 0 to 10 or an explanation.

    The last well-formed tag counts, else the last tag whose end is damaged. A
    damaged rating ends where a word does. Explanations are trimmed, may be
    empty and keep three lines; a missing quote is empty.
    """
    number = f"<rating>{_SOME}{_NUMBER}"
    rating = _last_of(body, f"{number}{_SOME}</rating>", rf"{number}(?![\p{{L}}\p{{N}}_])").cast("int")
    ends = rf"^{SPACE}|{SPACE}\z"
    explanation = F.regexp_replace(_tagged(body, "explanation", "quote|rating"), ends, "")
    quote = F.regexp_replace(F.coalesce(_tagged(body, "quote", "explanation|rating"), F.lit("")), ends, "")
    lines = F.array_join(F.slice(F.split(explanation, LINE), 1, 3), "\n")
    return F.when(rating.isNotNull() & explanation.isNotNull(), F.struct(rating.alias("rating"), lines.alias("explanation"), quote.alias("quote")))
