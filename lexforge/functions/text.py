"""Column functions over text, scores and names. All stay in the JVM unless their name ends in _udf."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = 0.6931471805599453
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(nan|NaN|inf|Infinity)$"


#: The characters of Unicode's White_Space property, and the four separators that Python's strip takes too.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space (Unicode) at both ends; no regular expression, so only the ends are looked at."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def text_hash(text: Column) -> Column:
    return F.sha2(strip(text), 256)


def content_hash(text: Column) -> Column:
    return F.sha2(collapse(text), 256)


def order_key(seed, salt, key) -> Column:
    """Stands for a seeded shuffle: order by it. Depends on seed, salt and key only, not on the order of the input."""
    cols = [x if isinstance(x, Column) else F.lit(str(x)) for x in (seed, salt, key)]
    return F.sha2(F.concat_ws(":", *[c.cast("string") for c in cols]), 256)


def token_count(text: Column) -> Column:
    """Runs of letters, marks and digits of any script."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{Nd}]+"), F.lit(0)))


def parse_score(raw: Column) -> tuple[Column, Column]:
    """(value, reason): reason is missing, nonnumeric:'x' or out_of_range:v; null where the value is in [0, 5]."""
    bare = F.coalesce(strip(raw), F.lit(""))
    number = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
    good = number.between(0.0, 5.0) & ~F.isnan(number)
    reason = (
        F.when(bare == "", F.lit("missing"))
        .when(number.isNull(), F.concat(F.lit("nonnumeric:'"), bare, F.lit("'")))
        .when(~good, F.concat(F.lit("out_of_range:"), bare))
    )
    return F.when(good, number), reason


def score_or_reason(text: Column, raw: Column) -> tuple[Column, Column]:
    """parse_score of a row's score; an empty text overrides every reason and leaves no value."""
    value, reason = parse_score(raw)
    empty = F.coalesce(strip(text), F.lit("")) == ""
    return F.when(~empty, value), F.when(empty, F.lit("empty_text")).otherwise(reason)


def score_bin(value: Column) -> Column:
    return F.least(F.lit(4), F.floor(value)).cast("int")


def clip(value: Column, low: float = 0.0, high: float = 5.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


#: Up to this many words are looked for by one pattern; a longer list is compared with all words of a text.
FEW_WORDS = 32


def words_of(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-zA-Z0-9]+")


def _pattern(words: list[str]) -> str | None:
    """Finds one of the words, whole; none if they are too many or not all plain ones."""
    if not 0 < len(words) <= FEW_WORDS or not all(re.fullmatch("[a-z0-9]+", w) for w in words):
        return None
    return f"(?<![a-zA-Z0-9])({'|'.join(words)})(?![a-zA-Z0-9])"


def has_any_word(text: Column, words: list[str]) -> Column:
    if pattern := _pattern(words):
        return F.lower(text).rlike(pattern)
    return F.arrays_overlap(words_of(text), F.array(*[F.lit(w) for w in words]))


def matched_words(text: Column, words: list[str]) -> Column:
    if pattern := _pattern(words):
        found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))
    else:
        found = F.array_intersect(words_of(text), F.array(*[F.lit(w) for w in words]))
    return F.array_join(F.array_sort(found), ", ")


def normal_word(line: Column) -> Column:
    """A line of a word list as a word, null for blanks and comments."""
    word = F.lower(F.regexp_replace(line, "[^a-zA-Z0-9]", ""))
    return F.when(~strip(line).startswith("#") & (word != ""), word)


def domain_of(url: Column, key: Column) -> Column:
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return F.coalesce(F.nullif(host, F.lit("")), F.concat(F.lit("no-url:"), key.cast("string")))


def eligible_article(text: Column, least: int = 200) -> Column:
    """Long enough, free of left-over markup, and not a list of short lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    mean = F.try_divide(F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)).cast("double"), F.size(lines))
    return (F.length(strip(text)) >= least) & ~text.rlike(r"(?i)<(div|table|span)") & ~((F.size(lines) >= 8) & (mean < 25))


def score_to_weight(score: Column, offset: float = 0.5, scale: float = 0.2) -> Column:
    return F.lit(offset) + score * F.lit(scale)


def bits_per_byte(loss: Column, tokens: Column, size: Column) -> Column:
    return F.try_divide(loss * tokens / F.lit(LN2), size)


def bucket(value: Column, low: Column, high: Column, names: tuple[str, str, str], low_first: bool = True) -> Column:
    """names[0] up to low, names[2] from high on (low_first) or above high, names[1] between."""
    upper = value >= high if low_first else value > high
    return F.when(value <= low, names[0]).when(upper, names[2]).otherwise(names[1])


def parse_reply(raw: Column, names: list[str]) -> tuple[Column, Column]:
    """(map name -> int, status): JSON after code fences are dropped; a missing or non-numeric value is searched for near its name."""
    bare = F.regexp_replace(strip(raw), r"^```[a-zA-Z]*\s*|\s*```$", "")
    found = []
    for name in names:
        told = F.get_json_object(bare, f"$.{name}")
        number = F.when(told.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.floor(told.try_cast("double")).cast("int"))
        near = F.regexp_extract(raw, "(?i)" + name.replace("_", "[_ ]?") + r"[^0-9]{0,8}([0-5])", 1)
        found.append(F.coalesce(number, F.nullif(near, F.lit("")).cast("int")))
    values = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*found))
    whole = found[0].isNotNull()
    for f in found[1:]:
        whole = whole & f.isNotNull()
    return values, F.when(whole, "ok").otherwise("failed")


def parse_budget(text: Column) -> Column:
    scale = F.regexp_extract(F.upper(text), "([KMB]?)$", 1)
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return (number * F.when(scale == "K", 1e3).when(scale == "M", 1e6).when(scale == "B", 1e9).otherwise(1.0)).cast("long")


def budget_label(n: Column) -> Column:
    return (
        F.when(n % 1_000_000 == 0, F.concat(F.floor(n / 1_000_000).cast("string"), F.lit("M")))
        .when(n % 1000 == 0, F.concat(F.floor(n / 1000).cast("string"), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def dimension_name(folder: Column) -> Column:
    return F.regexp_replace(folder, "_mean$", "")


def seed_of_run(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"seed(\d+)$", 1), F.lit("")), F.lit("unknown"))


def common_prefix_len(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long"))


def natural_key(name: Column) -> Column:
    """Sorts ids of numbers joined by dots or dashes by their numbers."""
    return F.array_join(F.transform(F.split(name, "[-.]"), lambda x: F.lpad(x, 12, "0")), ".")


def label_index(label: Column, labels: list[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), F.lower(F.trim(label)))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("int"))


def valid_repo_id(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9][A-Za-z0-9._-]*$")


def json_field(raw: Column, field: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(raw, f"$.{field}"), F.lit(default))


def pad_batch(ids: Column, width: Column, pad: int = 0) -> tuple[Column, Column]:
    """(padded ids, attention mask)."""
    gap = F.greatest(F.lit(0), width - F.size(ids))
    return F.concat(ids, F.array_repeat(F.lit(pad), gap)), F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), gap))


def fill_prompt(template: str, **fields: Column) -> Column:
    """The template with {name} replaced by columns."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


#: Fixed value: what a premise loses at its end.
SENTENCE_ENDS = " .!?\u061f\u3002"


def passage_prompt(passage: Column, question: Column) -> Column:
    return fill_prompt("Passage:\n{passage}\n\nQuestion: {question}\nAnswer:", passage=passage, question=question)


def premise_prompt(premise: Column, connector: Column) -> Column:
    """The premise without punctuation at its end, and the connector."""
    return F.concat(F.rtrim(premise, F.lit(SENTENCE_ENDS)), F.lit(" "), connector)


def topic_prompt(text: Column, topics: list[str]) -> Column:
    return fill_prompt("Topics: " + ", ".join(topics) + ".\n\nText:\n{text}\n\nTopic:", text=text)


def argmax_index(scores: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


# --- Unicode and legacy encodings: no JVM function normalises, so these are Arrow UDFs -----------------------------------------------


def nfc_udf() -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return run


def convert_legacy(text: str, spots: Mapping[str, str], ambiguous: Mapping[str, str], reorder: list[tuple[str, str]]) -> str:
    """Spot fixes, then the longest ambiguous sequences first, then the reordering patterns in order."""
    import re

    for a, b in spots.items():
        text = text.replace(a, b)
    if ambiguous:
        longest = "|".join(re.escape(x) for x in sorted(ambiguous, key=lambda x: (-len(x), x)))
        text = re.sub(longest, lambda m: ambiguous[m.group(0)], text)
    for pattern, to in reorder:
        text = re.sub(pattern, to, text)
    return text


def fix_text(text: str, spots: Mapping[str, str], ambiguous: Mapping[str, str], reorder: list[tuple[str, str]], detector: Callable[[str], float]) -> str:
    """Tiered: a text without an exclusive marker (a key of spots) isn't converted, whatever ambiguous characters it has; a detector above
    0.5 asks for the full conversion, else spots alone are fixed. In the end every text is in NFC."""
    if any(x in text for x in spots):
        full = detector(text) > 0.5
        text = convert_legacy(text, spots, ambiguous if full else {}, reorder if full else [])
    return unicodedata.normalize("NFC", text)


def fix_encoding_udf(spots: Mapping[str, str], ambiguous: Mapping[str, str], reorder: list[tuple[str, str]], detector: Callable[[str], float]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else fix_text(t, spots, ambiguous, reorder, detector))

    return run
