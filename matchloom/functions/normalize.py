"""Text normalisation as column expressions: null is the empty text throughout."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .tables import ADDRESS_WORDS, LEGAL_WORDS, NAME_WORDS, SHORT_ADDRESS_WORDS, SHORT_NAME_WORDS, STATES

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def latin_table() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose to one ASCII letter, and these letters."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKD", chr(cp))[:1]
        rest = unicodedata.normalize("NFKD", chr(cp))[1:]
        if base.isascii() and all(unicodedata.combining(c) for c in rest):
            pairs.append((chr(cp), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


# Latin letters without a decomposition.
LIGATURES = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("đ", "d"), ("ð", "d"), ("þ", "th"), ("ł", "l"), ("ı", "i"))


def to_ascii(c: ColumnOrName) -> Column:
    """Lower case without the diacritics of Latin letters; all inside the JVM."""
    out = F.lower(F.translate(F.coalesce(_col(c).cast("string"), F.lit("")), *latin_table()))
    for letter, plain in LIGATURES:
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


@F.pandas_udf(StringType())
def decomposed(texts: pd.Series) -> pd.Series:
    """NFKD without marks, for scripts beyond the Latin blocks (Arrow batches)."""
    return texts.map(lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)), na_action="ignore")


def basic(c: ColumnOrName) -> Column:
    """ASCII words in lower case, one blank between them; ``&`` is the word and."""
    return F.trim(F.regexp_replace(F.replace(to_ascii(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def tokens(c: ColumnOrName) -> Column:
    return F.filter(F.split(_col(c), " "), lambda t: t != "")


def _table(words: dict[str, str]) -> Column:
    """A constant map, parsed in one call."""
    return F.expr("map(" + ", ".join(f"'{a}', '{b}'" for a, b in words.items()) + ")")


def _list(words: tuple[str, ...]) -> Column:
    return F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")")


def expand(words: Column, table: dict[str, str]) -> Column:
    entries = _table(table)
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(entries, t), t))


def name(c: ColumnOrName) -> Column:
    return F.array_join(expand(tokens(basic(c)), NAME_WORDS), " ")


def address(c: ColumnOrName, country: ColumnOrName) -> Column:
    """Address words spelled out; in the US the last word, or the one before a final number, may be a state."""
    states, plain = _table(STATES), _table(ADDRESS_WORDS)

    def placed(words: Column) -> Column:
        count = F.size(words)
        place = F.when((count > 1) & F.try_element_at(words, count).rlike("^[0-9]+$"), count - 2).otherwise(count - 1)
        return F.transform(F.array(F.struct(words.alias("words"), place.alias("place"))), spelled)[0]

    def spelled(text: Column) -> Column:
        def word(t: Column, i: Column) -> Column:
            state = F.when((_col(country) == "US") & (i == text["place"]), F.try_element_at(states, t))
            return F.coalesce(state, F.try_element_at(plain, t), t)

        return F.array_join(F.transform(text["words"], word), " ")

    # As an element of an array the words are made once, not for each word.
    return F.transform(F.array(tokens(basic(c))), placed)[0]


def join_initials(c: ColumnOrName) -> Column:
    """Runs of single letters become one word."""
    return F.regexp_replace(_col(c), r"(?<=\b[a-z]) (?=[a-z]\b)", "")


def core(c: ColumnOrName) -> Column:
    """A normalised name without legal forms; the name itself if nothing is left."""
    legal = _list(LEGAL_WORDS)
    kept = F.filter(tokens(join_initials(c)), lambda t: ~F.array_contains(legal, t))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(_col(c))


def squash(c: ColumnOrName) -> Column:
    """Repeated characters once."""
    return F.regexp_replace(_col(c), r"(.)\1+", "$1")


def address_words(c: ColumnOrName) -> Column:
    return F.filter(tokens(c), lambda t: ~t.rlike("[0-9]"))


def numbers(c: ColumnOrName) -> Column:
    """Distinct digit runs without leading zeros."""
    runs = F.regexp_extract_all(_col(c), F.lit("[0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(runs, lambda d: F.regexp_replace(d, "^0+(?=[0-9])", "")))


def postcode(c: ColumnOrName) -> Column:
    """The last number that is not the first word, if it has five or six digits, else empty."""
    words = tokens(c)
    found = F.filter(F.when(F.size(words) > 1, F.slice(words, 2, F.size(words) - 1)), lambda t: t.rlike("^[0-9]+$"))
    last = F.try_element_at(found, F.lit(-1))
    return F.when(F.length(last).isin(5, 6), last).otherwise("")


def number_gap(a: Column, b: Column) -> Column:
    """Smallest distance between numbers that only one side has; -1 if a side has none of its own."""
    whole = lambda x: F.transform(x, lambda d: F.substring(d, 1, 12).cast("long"))
    mine, theirs = whole(F.array_except(a, b)), whole(F.array_except(b, a))
    gaps = F.flatten(F.transform(mine, lambda x: F.transform(theirs, lambda y: F.abs(x - y))))
    return F.coalesce(F.array_min(gaps), F.lit(-1)).cast("double")


def bucket(c: ColumnOrName, n: int = 10) -> Column:
    """crc32 of the id modulo n: 0-5 vectors, 6-8 matcher, 9 holdout."""
    return F.pmod(F.crc32(_col(c).cast("binary")), F.lit(n)).cast("int")


def id_list(c: ColumnOrName) -> Column:
    """Distinct ids of a comma list, trimmed, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def clean(c: ColumnOrName) -> Column:
    """Letters, marks and digits of any script in lower case."""
    text = F.replace(F.lower(F.coalesce(_col(c).cast("string"), F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}\s]", " "), r"\s+", " "))


def clean_name(c: ColumnOrName) -> Column:
    return F.array_join(expand(tokens(clean(c)), SHORT_NAME_WORDS), " ")


def clean_address(c: ColumnOrName) -> Column:
    return F.array_join(expand(tokens(clean(c)), SHORT_ADDRESS_WORDS), " ")
