"""Unicode folding and tokens, as column expressions."""

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Particles that carry little signal in names.
PARTICLES = ("al", "el", "ul", "bin", "bint", "ibn", "abu", "umm", "de", "van", "von", "der", "den", "del", "di", "du", "le", "la", "les", "los", "las")


@functools.cache
def _base_letters() -> tuple[str, str]:
    """Characters whose decomposition is one base character and nonspacing marks, and those bases."""
    marked, bases = [], []
    for code in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if parts != c:
            kept = [x for x in parts if unicodedata.category(x) != "Mn"]
            if len(kept) == 1 and kept[0] != c:
                marked.append(c)
                bases.append(kept[0])
    return "".join(marked), "".join(bases)


def strip_marks(text: Column) -> Column:
    """Letters without their nonspacing marks, composed or combining."""
    return F.regexp_replace(F.translate(text, *_base_letters()), r"\p{Mn}+", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(name: Column) -> Column:
    """Lower case, no marks, punctuation as space, single spaces; null becomes empty. Underscores stay."""
    return squeeze(F.regexp_replace(strip_marks(F.lower(F.coalesce(name, F.lit("")))), r"(?U)[^\w\s]", " "))


def tokens_of(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def tokenize(name: Column) -> Column:
    return tokens_of(normalize(name))


def tokenize_no_particles(name: Column) -> Column:
    return F.filter(tokenize(name), lambda t: ~t.isin(*PARTICLES))


def split_words(text: Column) -> Column:
    """Words between runs of any white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
