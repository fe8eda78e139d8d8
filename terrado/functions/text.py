"""Text keys and cleaners as native column expressions.

The keys differ on purpose: each serves one comparison, and merging them would
change what counts as equal.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks whose letters lose their accents by a one-to-one table.
_BLOCKS = ((0xC0, 0x250), (0x1E00, 0x1F00))


@cache
def _unaccent_table(form: str) -> tuple[str, str]:
    """Characters that become one other character when decomposed and stripped of combining marks."""
    source, target = [], []
    extra = range(0xA0, 0xC0) if form == "NFKD" else range(0)
    for code in [*extra, *(c for low, high in _BLOCKS for c in range(low, high))]:
        plain = "".join(x for x in unicodedata.normalize(form, chr(code)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != chr(code):
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


#: White space of any kind, as (?U)\s has it, and runs of it that are not one space.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANK_RUNS = rf"[{BLANKS}]{{2,}}|[{BLANKS.replace(' ', '')}]"
#: Of these the ones beyond Latin-1, which most texts have not; the others but the space, and their runs: one look-up in a table for each character.
FAR_BLANKS, NEAR_BLANKS = "".join(c for c in BLANKS if ord(c) > 0xFF), "".join(c for c in BLANKS if ord(c) <= 0xFF and c != " ")
NEAR_BLANK_RUNS = r"[\t-\r \x85\xa0]{2,}|[\t-\r\x85\xa0]"

#: What ends a line beside the plain line feed.
RARE_BREAKS = "\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029"


def unaccent(text: Column, form: str = "NFD") -> Column:
    """Text without accents: composed letters by a table, loose combining marks by pattern. NFKD also folds ² and its like. ASCII stays as it is."""
    folded = lambda x: F.regexp_replace(F.translate(x, *_unaccent_table(form)), r"\p{Mn}+", "")
    return let(text, lambda x: F.when(_is_ascii(x), x).otherwise(folded(x)))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end; Spark's trim strips spaces only."""
    return F.btrim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    has = lambda x, parts: reduce(or_, [x.contains(p) for p in parts])
    near = lambda x: F.when(has(x, ["  ", *NEAR_BLANKS]), F.regexp_replace(x, NEAR_BLANK_RUNS, " ")).otherwise(x)
    return let(text, lambda x: F.trim(F.when(_is_ascii(x) | ~has(x, FAR_BLANKS), near(x)).otherwise(F.regexp_replace(x, BLANK_RUNS, " "))))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def _alnum(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def _replaced(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, put in steps:
        text = F.regexp_replace(text, pattern, put)
    return text


# Street words and their short forms.
STREET_WORDS = (
    (r"\bcarrera\b|\bcra\.?\b|\bcr\.?\b", "kr"),
    (r"\bcalle\b|\bcl\.?\b", "cl"),
    (r"\bavenida\b|\bav\.?\b", "av"),
    (r"\bnumero\b|\bno\.?\b|#", " "),
)
# Roman numerals that are read as numbers, and words left out of place names; and what a text must have for them to be there.
PLACE_WORDS = (
    (r"\bxxiii\b", "23", "xxiii"),
    (r"\biv\b", "4", "iv"),
    (r"\biii\b", "3", "iii"),
    (r"\bii\b", "2", "ii"),
    (r"\bi\b", "1", "i"),
    (r"\b(?:et|etapa)\b", " ", "et"),
)


def address_key(text: Column) -> Column:
    """Key for addresses and texts compared by the duplicate detector; null counts as empty."""
    return _alnum(_replaced(F.lower(unaccent(F.coalesce(text, F.lit("")), "NFKD")), STREET_WORDS))


def place_key(text: Column) -> Column:
    """Key of place and building names: numerals as numbers, without "etapa". The key of two texts with a space between is their keys with one between."""
    put = lambda key, step: let(key, lambda x: F.when(x.contains(step[2]), F.regexp_replace(x, step[0], step[1])).otherwise(x))
    return _alnum(reduce(put, PLACE_WORDS, F.lower(unaccent(F.coalesce(text, F.lit(""))))))


def upper_key(text: Column, superscripts: bool = False) -> Column:
    """Upper case without accents, white space squeezed; one portal also writes ² and ³ as digits."""
    text = F.replace(F.replace(text, F.lit("²"), F.lit("2")), F.lit("³"), F.lit("3")) if superscripts else text
    return F.upper(unaccent(squeeze(text)))


def key_says(text: Column, words: Sequence[str]) -> Column:
    """Has the text's upper_key one of the words (letters only)? White space and what superscripts become are no part of such."""
    return let(F.upper(unaccent(text)), lambda x: reduce(or_, [x.contains(w) for w in words]))


def label_key(text: Column) -> Column:
    """Key of field labels: lower case, no colon, only the Spanish accents folded."""
    return strip(F.translate(F.replace(F.lower(text), F.lit(":"), F.lit("")), "áéíóúñ", "aeioun"))


def barrio_filter_key(text: Column) -> Column:
    """Key by which the search compares neighbourhoods; null if nothing is left."""
    key = _replaced(F.lower(unaccent(text)), ((r"[.,;:_/\\-]+", " "), (r"^(barrio|b|br|bo)\s+", ""), (r"\s+", " ")))
    return F.nullif(F.trim(key), F.lit(""))


def barrio_catalog_key(text: Column) -> Column:
    """Key of the neighbourhood catalog; null if nothing is left."""
    key = F.regexp_replace(place_key(text), r"^(barrio|vereda|corregimiento|b|br|bo)\s+", "")
    return F.nullif(F.trim(key), F.lit(""))


def type_key(text: Column, roman_numerals: bool = False) -> Column:
    """Key of property types; with roman_numerals the seeding variant, which reads them as numbers."""
    key = place_key(text) if roman_numerals else _alnum(F.lower(unaccent(text)))
    return F.nullif(key, F.lit(""))


def header_key(text: Column) -> Column:
    """Key of spreadsheet headers."""
    return squeeze(F.lower(unaccent(text)))


@cache
def _unescape():
    """Made at first use: workers import this module without a session."""

    def unescape(text: pd.Series) -> pd.Series:
        return text.map(html.unescape, na_action="ignore")

    return F.pandas_udf(unescape, "string")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(text: Column) -> Column:
    """Entities decoded, white space squeezed, blank to null. Texts without & stay on the native path."""
    return F.nullif(squeeze(F.when(text.contains("&"), _unescape()(text)).otherwise(text)), F.lit(""))


def lines(text: Column) -> Column:
    """Stripped lines that are not blank; null text has none."""
    rare = lambda x: reduce(or_, [x.contains(c) for c in RARE_BREAKS])
    parts = let(F.coalesce(text, F.lit("")), lambda x: F.when(rare(x), F.split(x, r"\R|[\x1c-\x1e\x85]")).otherwise(F.split(x, "\n")))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def title_case(text: Column) -> Column:
    """First letter after any non-letter in upper case, the others in lower case: o'higgins to O'Higgins."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2**31 - 1))), "")


def file_name(text: Column, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(clean_text(text), "[^a-zA-Z0-9_-]", "_"), 1, most)


# Words that end a place name, and its prefixes.
NOISE = (
    r"\b(?:publicidad|precio|negociable|info(?:rmes?)?|cuenta\s+con|consta\s+de|area|valor|contacto|whatsapp|mts?2?|metros?|frente|fondo)\b"
)
PREFIX = r"(?:barrio|vereda|corregimiento)(?:\s+de)?\s+"


def place_text(text: Column) -> Column:
    """A place name without its prefix, what follows a noise word, and marks at the ends; null if nothing is left."""
    ends = r"^[ ,.\-]+|[ ,.\-]+$"
    out = F.regexp_replace(squeeze(F.coalesce(text, F.lit(""))), ends, "")
    out = F.regexp_replace(out, rf"(?iU)^{PREFIX}", "")
    out = F.regexp_replace(out, rf"(?iU){NOISE}.*$", "")
    return F.nullif(F.regexp_replace(out, ends, ""), F.lit(""))
