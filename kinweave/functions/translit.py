"""Latin spellings of words in Indic scripts, from the names that Unicode gives their letters."""

from __future__ import annotations

import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands before what replaces the vowel that a consonant's name ends with.
JOIN = "\x01"


def _spelling(c: str) -> str | None:
    """A letter's own name, a vowel sign's after JOIN, JOIN alone for what silences a vowel, a digit's figure; None for the rest."""
    name = unicodedata.name(c, "")
    said = "".join(x for x in name.rsplit(" ", 1)[-1].lower() if x.isascii() and x.isalnum())
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    if "VOWEL SIGN" in name:
        return JOIN + said
    if name.endswith("VIRAMA"):
        return JOIN
    if name.endswith(("ANUSVARA", "BINDI", "CANDRABINDU", "TIPPI")):
        return "n"
    return said if " LETTER " in name else None


def spellings() -> dict[str, str]:
    """What each character of the Indic blocks is spelt as, where it is spelt at all."""
    found = {c: _spelling(c) for c in map(chr, range(0x900, 0xD80))}
    return {c: s for c, s in found.items() if s is not None}


def romanised(word: Column) -> Column:
    """A word in Latin letters and digits. A consonant's vowel goes where a vowel sign or a sign of silence follows; marks go."""
    table = F.create_map(*map(F.lit, chain.from_iterable(spellings().items())))
    spelt = F.array_join(F.transform(F.split(F.lower(word), ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.regexp_replace(F.regexp_replace(spelt, f"a{JOIN}", ""), "[^a-z0-9]", "")
