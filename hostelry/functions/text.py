"""Keys, shapes and parsers for text."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of Latin-1 with a mark, and the letter without it.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

#: Shapes of personal values.
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9][0-9 ().-]{7,}[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "tax_code": r"[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]",
}


def latin_key(text: Column) -> Column:
    """Comparison key of Latin-1 text: no case, no marks, & as and, other signs as single spaces."""
    plain = F.translate(F.lower(text), MARKED, PLAIN)
    words = F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
    return F.trim(words)


def normal_key(text: Column | str) -> Column:
    """Comparison key of any text: no case, no marks, & as and, other signs as single spaces.

    Texts of ASCII and marked Latin letters, nearly all of them, stay native; only the
    others go through Unicode's compatibility forms.
    """
    text = F.col(text) if isinstance(text, str) else text
    plain = rf"^[\x00-\x7F{MARKED}{MARKED.upper()}]*$"
    return F.when(text.rlike(plain), latin_key(text)).otherwise(_unicode_key(F.when(~text.rlike(plain), text)))


@F.pandas_udf(T.StringType())
def _unicode_key(texts: pd.Series) -> pd.Series:
    """The same key by Unicode; null stays null."""
    # Marks are what Unicode orders behind a letter, signs all that is neither letter nor number.
    marks, signs = regex.compile(r"(?V1)[\p{M}--\p{ccc=0}]+"), regex.compile(r"[^\p{Alphabetic}\p{N}]+")
    bare = texts.str.normalize("NFKD").map(lambda t: marks.sub("", t), na_action="ignore")
    spelt = bare.str.casefold().str.replace("&", " and ", regex=False)
    return spelt.map(lambda t: signs.sub(" ", t).strip(), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of matching blocks in both texts, to 4 places."""
    return pd.Series(
        [None if a is None or b is None else round(SequenceMatcher(None, a, b, autojunk=False).ratio(), 4) for a, b in zip(left, right)]
    )


@F.pandas_udf(T.IntegerType())
def transposing_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Edits between two texts where swapping neighbours is one (optimal string alignment)."""

    def distance(a: str, b: str) -> int:
        before, last = None, list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
                if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    best = min(best, before[j - 2] + 1)
                row.append(best)
            before, last = last, row
        return last[-1]

    return pd.Series([None if a is None or b is None else distance(a, b) for a, b in zip(left, right)])


def strip_currency(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?i)€|\beuro?\b|\beur\b", ""))


def parse_number(text: Column, decimal: str, thousands: str) -> Column:
    """A decimal by the given marks, groups of exactly three digits; null where the text is not one."""
    d, t = (f"\\{c}" for c in (decimal, thousands))
    grouped = rf"^-?([0-9]+|[0-9]{{1,3}}({t}[0-9]{{3}})+)({d}[0-9]+)?$"
    bare = F.replace(F.replace(F.trim(text), F.lit(thousands), F.lit("")), F.lit(decimal), F.lit("."))
    return F.when(F.trim(text).rlike(grouped), bare.try_cast("decimal(18,4)"))


def vat_number(raw: Column) -> Column:
    """Letters and digits in capitals; eleven digits are Italian."""
    bare = F.regexp_replace(F.upper(raw), "[^A-Z0-9]", "")
    return F.when(bare.rlike("^[0-9]{11}$"), F.concat(F.lit("IT"), bare)).otherwise(bare)


def iban_valid(raw: Column) -> Column:
    """Whether an account number's check digits hold (modulo 97)."""
    bare = F.regexp_replace(F.upper(raw), r"\s", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    digits = F.transform(
        F.split(turned, ""), lambda c: F.when(c.rlike("^[A-Z]$"), F.ascii(c) - 55).when(c.rlike("^[0-9]$"), F.ascii(c) - 48)
    )
    rest = F.aggregate(
        F.filter(digits, lambda v: v.isNotNull()), F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97
    )
    return F.coalesce(bare.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1), F.lit(False))


def masked(text: Column, mark: str = "***") -> Column:
    """``text`` with every personal value replaced."""
    for shape in SHAPES.values():
        text = F.regexp_replace(text, shape, mark)
    return text


def phrase_category(key: Column, phrases: dict[str, tuple[str, ...]]) -> Column:
    """The one category of which a phrase is in ``key``; OTHER if none or several are."""
    spaced = F.concat(F.lit(" "), key, F.lit(" "))
    hits = F.array_compact(
        F.array(
            *(
                F.when(F.greatest(*(F.contains(spaced, F.lit(f" {p} ")).cast("int") for p in (*words, words[0]))) == 1, F.lit(category))
                for category, words in phrases.items()
            )
        )
    )
    return F.when(F.size(hits) == 1, F.get(hits, 0)).otherwise(F.lit("OTHER"))


def document_number(raw: Column) -> Column:
    """The key of a document's number: single spaces, capitals."""
    return F.upper(F.trim(F.regexp_replace(raw, r"\s+", " ")))


def safe_file_name(path: Column, most: int = 255) -> Column:
    """The last part of a path, without control characters, of at most ``most`` characters."""
    return F.substring(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"[\x00-\x1f]", ""), 1, most)
