"""Czech listing text to canonical values, as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelwise.functions.keys import fixed_map, let

# Room layouts with the pattern that names each one, in the order they are tried.
DISPOSITION_PATTERNS = [
    (r"\bgarsoni[eé]ra\b", "garsoniera"),
    (r"\b1\s*\+\s*kk\b", "1+kk"),
    (r"\b1\s*\+\s*1\b", "1+1"),
    (r"\b2\s*\+\s*kk\b", "2+kk"),
    (r"\b2\s*\+\s*1\b", "2+1"),
    (r"\b3\s*\+\s*kk\b", "3+kk"),
    (r"\b3\s*\+\s*1\b", "3+1"),
    (r"\b4\s*\+\s*kk\b", "4+kk"),
    (r"\b4\s*\+\s*1\b", "4+1"),
    (r"\b5\s*\+\s*kk\b", "5+kk"),
    (r"\b5\s*\+\s*1\b", "5+1"),
    (r"\b[6-9]\s*\+\s*(kk|1)\b", "6+"),
    (r"\batypick[yáé]\b", "atypicky"),
]

# Folded ownership wording, in the order it is tried as a substring.
OWNERSHIP_WORDS = {
    "osobni": "osobni",
    "osobni vlastnictvi": "osobni",
    "ov": "osobni",
    "druzstevni": "druzstevni",
    "druzstevni vlastnictvi": "druzstevni",
    "dv": "druzstevni",
    "statni": "statni",
    "obecni": "statni",
    "statni / obecni": "statni",
}

# Folded building-material stems.
BUILDING_STEMS = {
    "panel": "panel",
    "panelovy": "panel",
    "panelova": "panel",
    "cihla": "cihla",
    "cihlovy": "cihla",
    "cihlova": "cihla",
    "smisena": "smisena",
    "smiseny": "smisena",
    "drevo": "drevo",
    "dreveny": "drevo",
    "drevena": "drevo",
    "kamen": "kamen",
    "kamenny": "kamen",
    "kamenna": "kamen",
    "ostatni": "ostatni",
}

# Folded condition wording, in the order it is tried as a substring.
CONDITION_WORDS = {
    "novostavba": "novostavba",
    "velmi dobry": "velmi_dobry",
    "dobry": "dobry",
    "v rekonstrukci": "v_rekonstrukci",
    "po rekonstrukci": "po_rekonstrukci",
    "pred rekonstrukci": "pred_rekonstrukci",
    "spatny": "spatny",
    "projekt": "projekt",
}

# Address abbreviations and what replaces them, in order.
ADDRESS_ABBREVIATIONS = [
    (r"\bul\.\s*", "ulice "),
    (r"\bnám\.\s*", "naměsti "),
    (r"\bnam\.\s*", "naměsti "),
    (r"\btř\.\s*", "třida "),
    (r"\btr\.\s*", "třida "),
    (r"\bč\.p\.\s*", ""),
    (r"\bč\.\s*", ""),
]

# Words accepted as yes and as no.
YES_WORDS = ["ano", "true", "1", "yes"]
NO_WORDS = ["ne", "false", "0", "no"]


def _fold_python(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _translate_table() -> tuple[str, str]:
    """(from, to) for ``translate``: each BMP character whose folded form is one other character,
    then the combining marks, which have no counterpart and so are deleted."""
    source, target, dropped = [], [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        folded = _fold_python(ch)
        if folded == "":
            dropped.append(ch)
        elif len(folded) == 1 and folded != ch:
            source.append(ch)
            target.append(folded)
    return "".join(source + dropped), "".join(target)


def strip_diacritics(col: Column) -> Column:
    """Drop accents inside the JVM.

    Covers every character of the basic plane whose compatibility decomposition is a single
    base character plus marks (all Czech and Latin letters). Characters that decompose into
    several (ligatures, fractions, Hangul) stay; :func:`strip_diacritics_full` folds those too.
    """
    return F.translate(col, *_translate_table())


def _full_fold(series: pd.Series) -> pd.Series:
    return series.map(_fold_python, na_action="ignore")


def strip_diacritics_full(col: Column) -> Column:
    """NFKD folding of any text, Arrow-batched."""
    return F.pandas_udf(_full_fold, "string")(col)


def normalize_for_match(col: Column) -> Column:
    """Folded, lower-cased, single-spaced form used to compare texts."""
    return F.trim(F.regexp_replace(F.lower(strip_diacritics(col)), r"(?U)\s+", " "))


def non_blank(col: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(col), F.lit(""))


def _first(branches: list[tuple[Column, Column | str]]) -> Column:
    out = None
    for cond, value in branches:
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def _contained(key: Column, words: dict[str, str]) -> Column:
    return _first([(F.contains(key, F.lit(w)), v) for w, v in words.items()])


def ownership_of(folded: Column) -> Column:
    """Ownership form of a text in :func:`normalize_for_match` form."""
    return F.when(folded != "", F.coalesce(fixed_map(OWNERSHIP_WORDS)[folded], _contained(folded, OWNERSHIP_WORDS)))


def building_type_of(folded: Column) -> Column:
    return F.when(folded != "", _contained(folded, BUILDING_STEMS))


def condition_of(folded: Column) -> Column:
    return F.when(folded != "", F.coalesce(fixed_map(CONDITION_WORDS)[folded], _contained(folded, CONDITION_WORDS)))


def parse_disposition(col: Column) -> Column:
    return let(
        strip_diacritics(col),
        lambda folded: _first([(folded.rlike("(?iU)" + p), v) for p, v in DISPOSITION_PATTERNS]),
    )


def parse_ownership(col: Column, strict: bool = False) -> Column:
    """Ownership form. ``strict`` accepts whole phrases only, so that 'druzstevni s prevodem
    do OV' is not taken for personal ownership by its last two letters."""
    if strict:
        return fixed_map(OWNERSHIP_WORDS)[normalize_for_match(col)]
    return let(normalize_for_match(col), ownership_of)


def parse_building_type(col: Column) -> Column:
    return let(normalize_for_match(col), building_type_of)


def parse_condition(col: Column) -> Column:
    return let(normalize_for_match(col), condition_of)


def parse_energy_class(col: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(col), r"(?U)\b([A-G])\b", 1), F.lit(""))


def floor_of(folded: Column) -> Column:
    """struct<current, total> of a text in :func:`normalize_for_match` form."""
    pair = r"(-?\d+)\s*\.?\s*(?:patro|np|podlazi)?\s*(?:z|of|/)\s*(\d+)"
    lone = r"(?U)\b(-?\d+)\b"
    ground = folded.rlike(r"(?U)\b(prizemi|zvysene\s*prizemi)\b")
    # an empty match is no match: every group takes at least a digit
    first, last, alone = F.regexp_extract(folded, pair, 1), F.regexp_extract(folded, pair, 2), F.regexp_extract(folded, lone, 1)
    current = F.when(ground, F.lit(0)).when(first != "", first.try_cast("int")).otherwise(alone.try_cast("int"))
    return F.struct(current.alias("current"), F.when(~ground, last.try_cast("int")).alias("total"))


def parse_floor(col: Column) -> Column:
    """struct<current, total>: ground-floor words, 'x of y', else a lone number."""
    return let(normalize_for_match(col), floor_of)


def normalize_address(col: Column) -> Column:
    """Expand street abbreviations and collapse blanks; accents stay."""
    out = col
    for pattern, replacement in ADDRESS_ABBREVIATIONS:
        out = F.regexp_replace(out, "(?iU)" + pattern, replacement)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def parse_house_number(col: Column) -> Column:
    """struct<popisne, orientacni> from '2128/175a'."""
    pattern = r"(?iU)\b(\d{1,5})\s*/\s*(\d{1,5}[a-z]?)\b"
    part = lambda i: F.nullif(F.regexp_extract(col, pattern, i), F.lit(""))
    return F.struct(part(1).alias("popisne"), part(2).alias("orientacni"))


def praha_district_from_postcode(col: Column) -> Column:
    digits = F.replace(col, F.lit(" "), F.lit(""))
    return F.when(
        digits.rlike("^1[1-9][0-9]{3}$"), F.concat(F.lit("Praha "), F.substring(digits, 2, 1))
    )


def to_int(col: Column) -> Column:
    """Text to integer; anything else is NULL."""
    return F.trim(col).try_cast("int")


def to_decimal(col: Column, precision: int = 14, scale: int = 2) -> Column:
    return F.trim(col).try_cast(f"decimal({precision},{scale})")


def to_bool(col: Column) -> Column:
    word = F.lower(F.trim(col))
    return F.when(word.isin(YES_WORDS), F.lit(True)).when(word.isin(NO_WORDS), F.lit(False))


def to_float_comma(col: Column) -> Column:
    """Text to double, accepting a decimal comma."""
    return F.replace(non_blank(col), F.lit(","), F.lit(".")).try_cast("double")


def join_number_suffix(number: Column, suffix: Column) -> Column:
    """House number plus letter when both are present."""
    n, s = non_blank(number), non_blank(suffix)
    return F.when(s.isNull(), n).otherwise(F.concat(n, s))


