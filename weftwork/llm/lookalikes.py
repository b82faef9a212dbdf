"""One consistent form for text that reads the same on screen (problem 2).

A transducer walks a string by grapheme clusters and rewrites each by the longest matching keys of one table,
compiled beforehand and checked for conflicts: full-width and other presentation forms become their ordinary
forms, every kind of single blank a blank, invisible characters nothing, look-alike letters of other scripts
their Latin model, with or without a mark, and decomposed letters the composed ones. What comes out is a form to compare by, kept beside the
stored text: a word wholly in look-alikes of another script reads the same as the Latin one and gets its form. Accents, letter case, digits
and two blanks in a row stay: they read differently. Rewriting is idempotent.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of other scripts that look like a Latin one, and hyphens that look like the common one.
LOOK_ALIKES = {
    # Cyrillic
    "АВЕЅІЈКМНОРСТУХҮѴԚԜӀԌ": "ABESIJKMHOPCTYXYVQWIG",
    "аеорсухѕіјһԁԛԝӏѵ": "aeopcyxsijhdqwlv",
    # Greek
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ABEZHIKMNOPTYXCJ",
    "οϲϳ": "ocj",
    # Armenian and Latin extensions
    "օսհɡ": "ouhg",
    # hyphens
    "‐‑": "--",
}


JOINER = "\u200d"


def _invisible(code: int, ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= code <= 0x180F or 0xFE00 <= code <= 0xFE0F or 0xE0000 <= code <= 0xE0FFF


@lru_cache(maxsize=1)
def compile_table() -> dict[str, str]:
    """Key -> what it becomes. Raises where two rules disagree or an output would be rewritten again."""
    table: dict[str, str] = {"\r\n": " "}

    def add(key: str, to: str) -> None:
        if key != to and table.setdefault(key, to) != to:
            raise ValueError(f"two rules for {key!r}: {table[key]!r} and {to!r}")

    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Cs", "Co") and not 0xE0000 <= code <= 0xE0FFF:
            continue
        if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85":
            add(ch, " ")
        elif _invisible(code, ch):
            add(ch, "")
        elif 0xFB00 <= code <= 0xFB06 or 0xFF01 <= code <= 0xFFEE or 0x1D400 <= code <= 0x1D7FF or 0x2160 <= code <= 0x217F:
            add(ch, unicodedata.normalize("NFKD", ch))
    for letters, models in LOOK_ALIKES.items():
        for a, b in zip(letters, models, strict=True):
            add(a, b)
    # accents: a decomposed letter, of any script, as its composed one; a look-alike with a mark as its model with the mark
    for code in range(0xC0, 0x30000):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and not 0xAC00 <= code < 0xD7A4 and unicodedata.normalize("NFC", ch) == ch and not any(p in table for p in parts):
            add(parts, ch)
    marks = sorted({m for key in table if len(key) > 1 for m in key[1:] if unicodedata.combining(m)})
    for letters, models in LOOK_ALIKES.items():
        for a, b in zip(letters, models, strict=True):
            for m in marks:
                if len(both := unicodedata.normalize("NFC", b + m)) == 1:
                    add(a + m, both)
    # follow chains once (a mathematical Greek letter becomes Greek, then Latin), then nothing may be left to do
    for key, to in table.items():
        table[key] = "".join(table.get(c, c) for c in to)
    for key, to in table.items():
        if any(c in table for c in to):
            raise ValueError(f"{key!r} becomes {to!r}, which would change again")
    return table


class Transducer:
    def __init__(self) -> None:
        self.table = compile_table()
        self.longest = max(map(len, self.table))
        self.clusters = regex.compile(r"\X").findall
        self.memo: dict[str, str] = {}

    def cluster(self, c: str) -> str:
        done = self.memo.get(c)
        if done is None:
            done = self._rewrite(c)
            if len(self.memo) > 100_000:
                self.memo.clear()
            if len(c) <= 16:
                self.memo[c] = done
        return done

    def _rewrite(self, c: str) -> str:
        # a joiner between two pictures makes one of them, so there it can be seen
        joined = JOINER in c and regex.search(r"\p{Extended_Pictographic}\uFE0F?\u200D\p{Extended_Pictographic}", c)
        c = unicodedata.normalize("NFD", c)
        out, i = [], 0
        while i < len(c):
            if joined and c[i] == JOINER:
                out.append(c[i])
                i += 1
                continue
            for n in range(min(self.longest, len(c) - i), 0, -1):
                to = self.table.get(c[i : i + n])
                if to is not None:
                    out.append(to)
                    i += n
                    break
            else:
                out.append(c[i])
                i += 1
        return unicodedata.normalize("NFC", "".join(out))

    def __call__(self, text: str) -> str:
        if text.isascii() and not any(c in text for c in "\t\n\v\f\r"):
            return text
        done = "".join(map(self.cluster, self.clusters(text)))
        # a mark that an invisible character kept from its base is a cluster of its own
        return done if unicodedata.is_normalized("NFC", done) else unicodedata.normalize("NFC", done)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


@F.pandas_udf(T.StringType())
def _consistent(texts: pd.Series) -> pd.Series:
    form = transducer()
    return pd.Series([None if t is None else form(t) for t in texts], dtype=object)


def consistent(text: Column | str) -> Column:
    """The consistent form of a text; null stays null, empty stays empty."""
    return _consistent(text)


def missing_address(address: Column) -> Column:
    """Null, empty, blank or one of the words that stand for no address."""
    return F.coalesce(F.upper(F.trim(address)).isin("", "NA", "N/A", "NULL"), F.lit(True))


def canonical_records(records: DataFrame) -> DataFrame:
    """``entity_id, country, business_name, business_address, same_name, same_address``: the different rows of the four
    columns with the consistent form of name and address beside them."""
    rows = records.select("entity_id", "country", "business_name", "business_address").distinct()
    return rows.withColumns({"same_name": consistent("business_name"), "same_address": consistent("business_address")})


def same_on_screen(records: DataFrame) -> DataFrame:
    """``id_a, id_b`` (``id_a < id_b``): records of one country, both with a name and an address, whose names and
    addresses read the same while the stored name or address differs. Blanks at either end can't be seen and are not compared.
    Only readings stored in at least two ways are joined with themselves, by a hash of the reading."""
    forms = canonical_records(records).filter(F.col("entity_id").isNotNull() & F.col("business_name").isNotNull() & ~missing_address(F.col("same_address")))
    keyed = forms.select(
        "entity_id",
        F.struct("country", F.trim("same_name").alias("n"), F.trim("same_address").alias("a")).alias("reading"),
        F.struct("business_name", "business_address").alias("stored"),
    ).withColumn("key", F.xxhash64("reading"))
    several = keyed.select("key", F.xxhash64("stored").alias("s")).groupBy("key").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).filter("lo <> hi").select("key")
    left = keyed.join(several, "key", "left_semi")
    a, b = left.alias("a"), left.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.entity_id") < F.col("b.entity_id")) & F.col("a.reading").eqNullSafe(F.col("b.reading")) & (F.col("a.stored") != F.col("b.stored")))
    return pairs.select(F.col("a.entity_id").alias("id_a"), F.col("b.entity_id").alias("id_b")).distinct()


def screen_classes(records: DataFrame) -> DataFrame:
    """``entity_id, class_id, n_stored, n_links``: one row for each record with name and address; ``class_id`` is the smallest id of its reading,
    ``n_stored`` in how many ways that is stored and ``n_links`` how many records store it in another way than this one."""
    forms = canonical_records(records).filter(F.col("entity_id").isNotNull() & F.col("business_name").isNotNull() & ~missing_address(F.col("same_address")))
    reading = [F.col("country"), F.trim("same_name").alias("n"), F.trim("same_address").alias("a")]
    rows = forms.select("entity_id", *reading, F.xxhash64("business_name", "business_address").alias("stored"))
    ways = rows.groupBy("country", "n", "a", "stored").agg(F.count(F.lit(1)).alias("n_own"), F.min("entity_id").alias("least"))
    whole = ways.groupBy("country", "n", "a").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n_stored"), F.sum("n_own").alias("n_all"))
    on = lambda *by: [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
    out = rows.alias("x").join(ways.alias("y"), on("country", "n", "a", "stored")).select("x.*", "y.n_own").alias("x").join(whole.alias("y"), on("country", "n", "a"))
    return out.groupBy("x.entity_id").agg(F.min("class_id").alias("class_id"), F.max("n_stored").alias("n_stored"), F.sum(F.col("n_all") - F.col("n_own")).alias("n_links"))
