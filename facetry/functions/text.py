"""Text cleaning, prompts and response checks as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Separator of composite labels.
COMPOSITE_SEPARATOR = "#####"

# Prompt wording.
PROMPT_OPENING = "Create a new product description based on this original:\n\n"
PROMPT_ATTRIBUTES = "\n\nProduct attributes:\n"
PROMPT_STYLE = "\n\nGenerate a variation that is: "
PROMPT_CLOSING = "\n\nReturn ONLY the new description, with no additional commentary."

# Shortest usable response and phrases that mark a refusal.
MIN_RESPONSE_LENGTH = 10
REFUSAL_MARKERS = [
    "I cannot",
    "I'm sorry",
    "I am sorry",
    "As an AI",
    "I'm not able",
    "I am not able",
    "I apologize",
    "cannot assist",
    "can't assist",
]
#: Finds a refusal phrase whatever its case; the one form of the list that checks use.
REFUSAL = "|".join(re.escape(m.lower()) for m in REFUSAL_MARKERS)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def clean_for_service(text: Column) -> Column:
    """One line, stripped; null and blank become a single blank."""
    one_line = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.coalesce(one_line, F.lit("")) == "", F.lit(" ")).otherwise(one_line)


def clean_for_local(text: Column) -> Column:
    """One line, outer blanks kept; null and blank become empty."""
    blank = F.coalesce(strip(text), F.lit("")) == ""
    return F.when(blank, F.lit("")).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))


def normalise_label(label: Column, separator: str = COMPOSITE_SEPARATOR) -> Column:
    """``a#####b`` to ``a b`` with runs of blanks collapsed; null becomes empty."""
    spaced = strip(F.replace(F.coalesce(label, F.lit("")), F.lit(separator), F.lit(" ")))
    return F.regexp_replace(spaced, " {2,}", " ")


def plain_label(label: Column) -> Column:
    """Stripped label; null becomes empty."""
    return strip(F.coalesce(label, F.lit("")))


def composite(columns: list[Column], separator: str = " ") -> Column:
    """Join columns, a null counting as empty text so the separator stays."""
    return F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def prompt(base: Column, instruction: Column, attributes: dict[str, Column] | None = None) -> Column:
    parts = [F.lit(PROMPT_OPENING + '"'), base, F.lit('"')]
    if attributes:
        lines = [
            F.concat(F.lit(f"- {name}: "), F.coalesce(c.cast("string"), F.lit("None")))
            for name, c in attributes.items()
        ]
        parts += [F.lit(PROMPT_ATTRIBUTES), F.concat_ws("\n", *lines)]
    return F.concat(*parts, F.lit(PROMPT_STYLE), instruction, F.lit(PROMPT_CLOSING))


def usable_response(response: Column, min_length: int = MIN_RESPONSE_LENGTH) -> Column:
    """Long enough once stripped and free of refusal phrases, whatever their case."""
    trimmed = strip(response)
    return F.coalesce((F.length(trimmed) >= min_length) & ~F.lower(trimmed).rlike(REFUSAL), F.lit(False))
