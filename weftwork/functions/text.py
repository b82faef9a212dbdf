"""Cleaning of names and addresses, token by token (column expressions; only Unicode decomposition needs Python)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.functions.wordlists import ADDRESS_WORDS, FILLER_WORDS, INDIAN_STATES, LEGAL_WORDS, NAME_WORDS, US_STATES, WEAK_LEGAL

INDIC = "[\\u0900-\\u0DFF]"
STATES = US_STATES | INDIAN_STATES
ADDRESS_MAP = ADDRESS_WORDS | STATES


@F.pandas_udf(T.StringType())
def _decompose(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t if t.isascii() else unicodedata.normalize("NFKD", t) for t in texts], dtype=object)


def squeeze(text: Column) -> Column:
    """Runs of blanks to one, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean(text: Column | str, decompose: bool = True) -> Column:
    """Lower case without accents; web endings gone, ``&`` a word, all other signs blanks. Null becomes empty. ``decompose=False``
    leaves out the one step in Python, for text known to be plain."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    if decompose:
        text = F.regexp_replace(_decompose(text), r"\p{Mn}", "")
    text = F.regexp_replace(F.lower(text), "&", " & ")
    text = F.regexp_replace(text, r"\.(?:com|in|net|org|co|fr)\b|www\.", " ")
    return squeeze(F.regexp_replace(text, r"[^\p{L}\p{N}&]+", " "))


def multiword_states(text: Column) -> Column:
    """State names of several words to their codes, the longest first."""
    for name in sorted((s for s in STATES if " " in s), key=lambda s: (-len(s), s)):
        text = F.regexp_replace(text, rf"\b{name}\b", STATES[name])
    return text


def split_words(text: Column) -> Column:
    """Words between single blanks; the empty text has none."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def undo_digits(word: Column) -> Column:
    """Digits that stand for letters, in words that hold both (``sh0shana``) and are no ordinal (``1st``, ``12b``)."""
    mixed = word.rlike("[a-z]") & word.rlike("[0-9]") & ~word.rlike("^[0-9]+[a-z]{1,2}$")
    return F.when(mixed, F.translate(word, "013547", "olesat")).otherwise(word)


def mapped(words: Column, table: dict[str, str]) -> Column:
    """Each word by the table, unknown ones as they are."""
    lookup = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.element_at(lookup, w), w))


def name_tokens(clean_name: Column) -> Column:
    return mapped(F.transform(split_words(clean_name), undo_digits), NAME_WORDS)


def address_tokens(clean_address: Column) -> Column:
    """Two lookups in a row: what the first makes of a word may be a state."""
    return mapped(mapped(split_words(clean_address), ADDRESS_WORDS), STATES)


def add_clean(records: DataFrame, decompose: bool = True) -> DataFrame:
    """``nm`` and ``ad``: the clean name and address, from ``name_lat`` and ``addr_lat`` where there are such columns."""
    name = "name_lat" if "name_lat" in records.columns else "business_name"
    address = "addr_lat" if "addr_lat" in records.columns else "business_address"
    return records.withColumns({"nm": clean(name, decompose), "ad": multiword_states(clean(address, decompose))})


def prepare(records: DataFrame) -> DataFrame:
    """What pairs are compared by, from ``nm``, ``ad`` and the name as stored: ``core``, ``legal``, ``adc``, ``nums`` (in order of
    appearance, each once), ``num0`` (null without digits) and the flags ``indic``, ``webname``, ``alias``."""
    tokens = name_tokens(F.col("nm"))
    core = F.filter(tokens, lambda w: ~w.isin(LEGAL_WORDS + FILLER_WORDS))
    legal = F.filter(tokens, lambda w: w.isin([w for w in LEGAL_WORDS if w not in WEAK_LEGAL]))
    nums = F.array_distinct(F.regexp_extract_all(F.col("ad"), F.lit(r"(?U)\d+"), 0))
    stored = F.coalesce(F.col("business_name"), F.lit(""))
    return records.withColumns(
        {
            "core": F.array_join(core, " "),
            "legal": F.array_join(F.array_sort(F.array_distinct(legal)), " "),
            "adc": F.array_join(mapped(split_words(F.col("ad")), ADDRESS_MAP), " "),
            "nums": nums,
            "num0": F.get(nums, F.lit(0)),
            "indic": stored.rlike(INDIC),
            "webname": stored.rlike(r"(?iU)\.com|\.in\b|^[#@]"),
            "alias": stored.rlike(r"(?iU)\b(?:dba|fka|aka|a/k/a|d/b/a|f/k/a)\b"),
        }
    )


def script_words(text: Column) -> Column:
    """Lower-case words that keep their combining marks, for dictionaries between scripts."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " ")), " ")


def model_text(name: Column, address: Column, clean_name: Column, indic: Column) -> Column:
    """One text for a text model: name and address as stored, with the clean name beside one in an Indic script."""
    name, address = squeeze(F.coalesce(name, F.lit(""))), squeeze(F.coalesce(address, F.lit("")))
    return F.concat(name, F.when(indic, F.concat(F.lit(" / "), clean_name)).otherwise(""), F.lit(" | "), address)
