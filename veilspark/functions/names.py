"""Russian personal names by rules: stems, canonical keys. An approximation of a morphological dictionary."""

from __future__ import annotations

from pyspark.sql import Column
from veilspark.functions import fx as F

# Case endings, first match wins: (ending, what replaces it). Feminine surnames stay feminine.
ENDINGS = (
    (r"(ов|ев|ёв|ин|ын)(?:у|ым|е|ыми|ых)$", "$1"),
    (r"(ов|ев|ёв|ин|ын)(?:ой|ою)$", "$1а"),
    (r"(ск|цк)(?:ого|ому|им|ом|ий|ие|их)$", "$1ий"),
    (r"(ск|цк)(?:ой|ую|ая)$", "$1ая"),
    (r"(ович|евич|ьич)(?:а|у|ем|ом|е)$", "$1"),
    (r"(овн|евн|ичн)(?:а|ы|е|у|ой|ою)$", "$1а"),
)


def name_stem(token: Column) -> Column:
    """The nominative, or for other words the stem, in lower case; an initial is its letter and a point."""
    t = F.regexp_replace(F.lower(token), "[.]+$", "")
    out = F.when(F.length(t) <= 1, F.concat(F.upper(t), F.lit(".")))
    for pattern, to in ENDINGS:
        out = out.when(t.rlike(pattern), F.regexp_replace(t, pattern, to))
    kept = t.rlike(r"(?:ов|ев|ёв|ин|ын|ова|ева|ёва|ина|ына)$")
    return out.when(kept, t).when(F.length(t) >= 4, F.regexp_replace(t, r"(?:ой|ей|ом|ем|ою|[аяыиуюе])$", "")).otherwise(t)


def person_canonical(name: Column) -> Column:
    tokens = F.regexp_extract_all(name, F.lit(r"[А-Яа-яЁёA-Za-z]+\.?"), F.lit(0))
    return F.when(F.size(tokens) == 0, F.lower(F.trim(name))).otherwise(F.array_join(F.transform(tokens, name_stem), " "))


def surname_key(canonical: Column) -> Column:
    return F.element_at(F.split(canonical, " "), 1)
