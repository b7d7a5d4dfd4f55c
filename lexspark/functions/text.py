"""String columns: clean-up, extraction, classification, wording."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import fixed

# Whitespace as Python strings see it: controls one by one (Java tests those by table), Unicode spaces by category.
SPACE = r"[ \t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\p{Z}]"
_SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                            0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def squeeze(text: Column) -> Column:
    """Every run of whitespace becomes one space; none is left at the ends."""
    return F.trim(single_spaces(text))


def single_spaces(text: Column) -> Column:
    """Every run of whitespace becomes one space, at the ends too."""
    return F.regexp_replace(text, SPACE + "+", " ")


def strip(text: Column) -> Column:
    """Whitespace of any kind removed from both ends, inner text untouched."""
    return F.btrim(text, F.lit(_SPACES))


def once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """``keep`` and new columns, each computed once per row.

    A plain select followed by a filter makes the optimizer copy the expressions into the filter;
    for regular expressions over whole texts that doubles the work. A generator is not copied.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def cut(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters (code points); None keeps the text whole."""
    return text if chars is None else F.substring(text, 1, chars)


def or_default(value: Column, default: str) -> Column:
    """NULL and the empty string both give the default."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match, or NULL (not '') when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def amount(text: Column) -> Column:
    """First rupee amount as bigint; NULL if there is none or it is no number."""
    digits = F.regexp_replace(F.regexp_extract(text, fixed.AMOUNT, 1), ",", "")
    return digits.try_cast("bigint")


def prefixed_id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def fill(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places filled from columns; NULL counts as empty text."""
    parts = []
    for index, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if index % 2:
            parts.append(F.coalesce(values[piece].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def keywords(title: Column, body: Column, body_chars: int | None = None, most: int | None = None) -> Column:
    """Capitalised phrases of one to three words, in order of first sight, as a comma list; all of them by default."""
    text = F.concat_ws(" ", title, cut(body, body_chars))
    found = F.regexp_extract_all(text, F.lit(fixed.CAPITALISED_PHRASE), F.lit(0))
    distinct = F.array_distinct(found)
    return F.array_join(distinct if most is None else F.slice(distinct, 1, most), ", ")


def chapter_heading(page: Column) -> Column:
    return F.concat(F.lit("CHAPTER "), extract(page, fixed.CHAPTER))


def section_reference(question: Column) -> Column:
    return extract(question, fixed.SECTION_REFERENCE)


def cited_sections(context: Column) -> Column:
    return F.regexp_extract_all(context, F.lit(fixed.CITED_SECTION), F.lit(1))


def is_section_number(query: Column) -> Column:
    return strip(query).rlike(fixed.SECTION_NUMBER)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def ladder(text: Column, rungs: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Label of the first rung of which any word occurs in the lower-cased text."""
    lowered = F.lower(text)
    label = F.lit(default)
    for name, words in reversed(rungs):
        label = F.when(contains_any(lowered, words), F.lit(name)).otherwise(label)
    return label


def script_flag(text: Column, block: str = fixed.DEVANAGARI, threshold: float = 0.5,
                inside: str = "hi", outside: str = "en") -> Column:
    """``inside`` when at least this share of the letters and marks lies in a character block."""
    letters = F.regexp_count(text, F.lit(r"[\p{L}\p{M}]"))
    share = F.regexp_count(text, F.lit(block)) / F.nullif(letters, F.lit(0))
    return F.when(share >= threshold, F.lit(inside)).otherwise(F.lit(outside))


def change_detail(change: Column, old: Column, new: Column) -> Column:
    detail = F.lit(fixed.CHANGE_DETAIL_OTHER)
    for name, template in fixed.CHANGE_DETAIL.items():
        detail = F.when(change == name, fill(template, old=old, new=new)).otherwise(detail)
    return detail


def change_impact(change: Column) -> Column:
    impact = F.lit(fixed.CHANGE_IMPACT_OTHER)
    for name, wording in fixed.CHANGE_IMPACT.items():
        impact = F.when(change == name, F.lit(wording)).otherwise(impact)
    return impact


def similarity(distance: Column) -> Column:
    return F.round(1 / (1 + distance), 4)


def option_letter(answer: Column) -> Column:
    return F.coalesce(F.upper(strip(F.nullif(answer, F.lit("")))), F.lit("A"))


def option_text(letter: Column, answer: Column, options: dict[str, Column]) -> Column:
    """Text of the lettered option; an unknown letter gives the answer as it was written."""
    text = answer
    for name, option in options.items():
        text = F.when(letter == name, option).otherwise(text)
    return or_default(text, "")


def prompt(question: Column, context: Column | None = None, role: str = fixed.ASSISTANT_ROLE,
           context_chars: int | None = None) -> Column:
    """Role, optional context (whole by default) and question for a model."""
    tail = [F.lit(fixed.PROMPT_QUESTION), question, F.lit(fixed.PROMPT_ANSWER)]
    plain = F.concat(F.lit(role), *tail)
    if context is None:
        return plain
    grounded = F.concat(F.lit(role), F.lit(fixed.PROMPT_CONTEXT), cut(context, context_chars), *tail)
    return F.when(context != "", grounded).otherwise(plain)


def clean_answer(reply: Column, asked: Column) -> Column:
    """What follows the last answer mark; without a mark, what follows the prompt."""
    after_prompt = F.substring(reply, F.length(asked) + 1, F.length(reply))
    text = (
        F.when(F.contains(reply, F.lit(fixed.ANSWER_MARK)), F.substring_index(reply, fixed.ANSWER_MARK, -1))
        .when(F.contains(reply, F.lit(fixed.ANSWER_MARK_HINDI)),
              F.substring_index(reply, fixed.ANSWER_MARK_HINDI, -1))
        .otherwise(after_prompt)
    )
    return strip(text)


def template_answer(question: Column, context: Column) -> Column:
    """Answer without a model: names the first section cited in the context."""
    first = F.try_element_at(cited_sections(context), F.lit(1))
    cited = fill(fixed.TEMPLATE_ANSWER, section=first, question=F.lower(question))
    return F.when(first.isNotNull(), cited).otherwise(F.lit(fixed.TEMPLATE_ANSWER_PLAIN))


def sources_answer(sources: Column) -> Column:
    """Numbered list of an ordered array of (source_law, section_number, title) structs."""
    lines = F.transform(
        sources,
        lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s.source_law, F.lit(" Section "),
                              s.section_number, F.lit(": "), s.title, F.lit("\n")),
    )
    return F.concat(F.lit(fixed.SOURCES_ANSWER), F.array_join(lines, ""))


def score_keywords(correct_text: Column) -> Column:
    """First five words longer than four characters, lower-cased."""
    words = F.split(squeeze(correct_text), " ")
    kept = F.filter(words, lambda w: F.length(w) > fixed.EVALUATION_KEYWORD_CHARS)
    return F.transform(F.slice(kept, 1, fixed.EVALUATION_KEYWORDS), F.lower)


def matched_keywords(words: Column, answer: Column) -> Column:
    lowered = F.lower(answer)
    return F.size(F.filter(words, lambda w: F.contains(lowered, w))).cast("bigint")


def first_long_word(question: Column) -> Column:
    """First lower-cased word longer than three characters, ``section`` if there is none."""
    words = F.filter(F.split(squeeze(F.lower(question)), " "), lambda w: F.length(w) > 3)
    return F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(fixed.DEFAULT_KEYWORD))
