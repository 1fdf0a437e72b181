"""Column expressions on whole texts shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of the six ASCII white-space characters that separate words.
WORD_GAP = r"[ \t-\r]+"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def free_names(carry: tuple[str, ...], taken: tuple[str, ...]) -> list[str]:
    """Names of carried columns in a result that has the columns ``taken``: their own, with
    ``_`` added as often as it takes where that is a result's or an earlier one's, in any case."""
    used, out = {t.lower() for t in taken}, []
    for name in carry:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")
