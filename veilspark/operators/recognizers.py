"""Recognizers as data: a label, its patterns with base scores, and a validator over the match.

A validator gives the score of a match, 0 to drop it. Patterns are Java regular expressions with Unicode classes
((?U), or (?iU) where case doesn't matter); they never match an empty string and capture nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from veilspark.functions import fx as F

from veilspark.functions import checks
from veilspark.functions.spans import empty, hits, span
from veilspark.plans.config import PiiConfig

Validator = Callable[[Column, PiiConfig], Column]


@dataclass(frozen=True)
class Recognizer:
    label: str
    patterns: tuple[tuple[str, float], ...]
    validate: Validator | None = None
    source: str = "pattern"

    def spans(self, text: Column, config: PiiConfig) -> Column:
        """All matches of all patterns, as an array of spans."""
        found = []
        for pattern, base in self.patterns:
            found.append(self._scored(hits(text, pattern), base, config))
        return F.concat(*found) if found else empty()


    def _scored(self, found: Column, base: float, config: PiiConfig) -> Column:
        if self.validate is None:
            return F.transform(found, lambda h: span(self.label, h["text"], h["start"], F.lit(base), self.source))
        each = F.transform(found, lambda h: span(self.label, h["text"], h["start"], self.validate(h["text"], config), self.source))
        return F.filter(each, lambda e: e["confidence"] > 0)


def _score(ok: Column, value: float) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))


def _validated(value: float, rule: Callable[[Column, Column, PiiConfig], Column]) -> Validator:
    return lambda m, config: _score(checks.let(checks.digits(m), lambda d: rule(m, d, config)), 1.0 if config.validator_score_one else value)


def _phone(m: Column, config: PiiConfig) -> Column:
    return checks.let(checks.digits(m), lambda d: _phone_score(m, d))


def _phone_score(m: Column, d: Column) -> Column:
    prefixed, n = F.trim(m).rlike(checks.PHONE_PREFIX), F.length(d)
    bad = (F.length(F.regexp_replace(m, r"[^.]", "")) >= 2) | F.trim(m).rlike(checks.SNILS_SHAPE) | (checks.snils(d) & ~prefixed) | checks.inn10(d)
    return F.when(bad, 0.0).when((n == 11) & F.substring(d, 1, 1).isin("7", "8"), 0.95).when((n == 10) & prefixed, 0.85).otherwise(0.0)


def _chat(m: Column, config: PiiConfig) -> Column:
    t = F.regexp_replace(m, "[^0-9-]", "")
    n = F.length(checks.digits(m))
    return F.when(t.startswith("-100") & (F.length(t) >= 13), 0.98).when(m.rlike(r"(?iU)(?:chat|tg|telegram)") & n.between(5, 15), 0.9).otherwise(0.0)


# Letters of vehicle plates.
PLATE = "АВЕКМНОРСТУХABEKMHOPCTYXАБГДЗИЙЛПФЦЧШЩЭЮЯ"

# The patterns and their base scores.
RECOGNIZERS = (
    Recognizer("RU_INN", ((r"(?U)\b\d{10}\b", 0.5), (r"(?U)\b\d{12}\b", 0.4)), _validated(0.95, lambda m, d, c: checks.inn(d, c.inn12_official))),
    Recognizer("RU_SNILS", ((r"(?U)\b\d{3}-\d{3}-\d{3}\s?\d{2}\b", 0.6), (r"(?U)\b\d{11}\b", 0.3)), _validated(0.95, lambda m, d, c: checks.snils(d))),
    Recognizer("RU_PASSPORT", ((r"(?U)\b\d{2}\s\d{2}\s\d{6}\b", 0.85), (r"(?U)\b\d{2}[-\s]\d{2}[-\s]?\d{6}\b", 0.8), (r"(?U)\b\d{4}[\s\-]?\d{6}\b", 0.65)), _validated(0.9, lambda m, d, c: (F.length(d) == 10) & (F.substring(d, 1, 4) != "0000") & ~checks.inn10(d))),
    Recognizer("RU_INT_PASSPORT", ((r"(?U)\b\d{2}\s?\d{7}\b", 0.45),)),
    Recognizer("RU_DRIVER_LICENSE", ((r"(?iU)\b\d{2}\s+[А-Яа-яA-Za-z]{2}\s+\d{6}\b", 0.85), (r"(?iU)\b\d{2}\s*[А-Яа-яA-Za-z]{2}\s*\d{6}\b", 0.7)), _validated(0.9, lambda m, d, c: (F.length(d) == 8) & (F.length(F.regexp_replace(m, r"[^\p{L}]", "")) == 2))),
    Recognizer("RU_OMS", ((r"(?U)\b\d{16}\b", 0.3),)),
    Recognizer("RU_VEHICLE_PLATE", ((rf"(?iU)\b[{PLATE}]\s*\d{{3}}\s*[{PLATE}]{{2}}\s*\d{{2,3}}\b", 0.85), (rf"(?iU)\b[{PLATE}]\d{{3}}[{PLATE}]{{2}}\d{{2,3}}\b", 0.8))),
    Recognizer("TG_CHAT_ID", ((r"(?U)(?<!\d)-100\d{10,}(?!\d)", 0.95), (r"(?iU)(?:chat[_\s-]?id|tg[_\s-]?id|telegram\s*id)\s*[=:]?\s*-?\d{5,15}\b", 0.85)), _chat),
    Recognizer("GPS_COORDS", ((r"(?U)\b-?\d{1,3}\.\d{3,10}[,\s]+-?\d{1,3}\.\d{3,10}\b", 0.5),)),
    Recognizer("PHONE_NUMBER", ((r"(?U)(?<!\d)\+7[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?!\d)", 0.9), (r"(?U)(?<!\d)8[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?!\d)", 0.85), (r"(?U)(?<!\d)(?:\+7|8|7)\d{10}(?!\d)", 0.8)), _phone),
    Recognizer("MAC_ADDRESS", ((r"(?iU)\b(?:[0-9A-F]{2}:){5}[0-9A-F]{2}\b", 0.9), (r"(?iU)\b(?:[0-9A-F]{2}-){5}[0-9A-F]{2}\b", 0.9), (r"(?iU)\b(?:[0-9A-F]{4}\.){2}[0-9A-F]{4}\b", 0.85))),
    Recognizer("RU_ACCOUNT", ((r"(?U)\b\d{20}\b", 0.55), (r"(?U)\b\d{5}\s\d{3}\s\d{1}\s\d{4}\s\d{7}\b", 0.7)), _validated(0.9, lambda m, d, c: (F.length(d) == 20) & (F.substring(d, 1, 1) != "0"))),
    Recognizer("RU_BIK", ((r"(?U)\b\d{9}\b", 0.4),), _validated(0.9, lambda m, d, c: F.substring(d, 1, 2).isin("04", "01", "00"))),
    # International identifiers; their patterns are this project's own.
    Recognizer("EMAIL_ADDRESS", ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 0.85),)),
    Recognizer("IP_ADDRESS", ((r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])", 0.6), (r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])", 0.6))),
    Recognizer("CREDIT_CARD", ((r"(?U)(?<!\d)[3-6]\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)", 0.9), (r"(?U)(?<!\d)3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\d)", 0.9)), _validated(0.9, lambda m, d, c: checks.luhn(d))),
    Recognizer("IBAN_CODE", ((r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 0.9),), _validated(0.9, lambda m, d, c: checks.iban(m))),
    Recognizer("CRYPTO", ((r"\b(?:bc1[a-z0-9]{25,59}|[13][a-km-zA-HJ-NP-Z1-9]{25,34}|0x[0-9a-fA-F]{40})\b", 0.8),)),
    Recognizer("DATE_TIME", ((r"(?U)\b(?:\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}-\d{2}-\d{2})\b", 0.6),)),
)

# Rules in place of a language model: names with a patronymic or initials, legal forms with a quoted name, marked places.
_W = r"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?"
_PATRONYMIC = r"[А-ЯЁ][а-яё]*(?:ович|евич|ьич|ич|овна|евна|ична|инична)(?:а|у|ем|ом|е|ы|ой)?"
RULES = (
    Recognizer("PERSON", ((rf"(?U)\b{_W}[ \t]+{_W}[ \t]+{_PATRONYMIC}\b", 0.85), (rf"(?U)\b{_W}[ \t]+{_PATRONYMIC}[ \t]+{_W}\b", 0.85), (rf"(?U)\b{_W}[ \t]+[А-ЯЁ]\.[ \t]?[А-ЯЁ]\.", 0.85), (rf"(?U)\b[А-ЯЁ]\.[ \t]?[А-ЯЁ]\.[ \t]?{_W}\b", 0.85)), source="ner"),
    Recognizer("ORGANIZATION", ((r"(?U)\b(?:ООО|ОАО|АО|ЗАО|ПАО|НКО|ФГУП|ГУП)[ \t]+[\"«“][^\"»”\n]{1,80}[\"»”]", 0.85),), source="ner"),
    Recognizer("LOCATION", ((rf"(?U)(?<=\bг\.[ ]?){_W}(?:[ ]{_W})?\b", 0.85), (rf"(?U)\b(?:ул|пр|просп|пер|наб)\.[ ]?{_W}\b", 0.85)), source="ner"),
)
