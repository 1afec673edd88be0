"""Predicates over found spans: rejection, rescoring by the words around, thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from veilspark.functions import fx as F

from veilspark.functions import checks
from veilspark.functions.labels import lookup
from veilspark.functions.spans import empty, span, window
from veilspark.plans.config import PiiConfig

# Keywords that raise a label's score when they stand near, as substrings of the lower-case window.
CONTEXT = {
    "RU_PASSPORT": ("паспорт", "паспорта", "паспорту", "паспортные", "серия и номер"),
    "RU_INT_PASSPORT": ("загран", "заграничн", "загранпаспорт"),
    "PHONE_NUMBER": ("тел", "телефон", "моб", "мобильн", "phone", "факс", "звон"),
    "RU_INN": ("инн", "идентификационн"),
    "RU_SNILS": ("снилс", "страховой номер"),
    "RU_BIK": ("бик", "банк"),
    "RU_ACCOUNT": ("р/с", "р.\\с", "расчётн", "расчетн", "счёт", "счет", "к/с", "корр"),
    "RU_DRIVER_LICENSE": ("водительск", "в/у", "права", "удостоверен"),
    "RU_VEHICLE_PLATE": ("госномер", "гос. номер", "грз", "автомоб", "машин", "номерной знак"),
    "MAC_ADDRESS": ("mac", "мак-адрес", "мак адрес", "физический адрес"),
    "TG_CHAT_ID": ("telegram", "телеграм", "chat_id", "chatid", "tg_id", "tg id"),
    "RU_OMS": ("омс", "полис"),
    "GPS_COORDS": ("gps", "координат", "широт", "долгот"),
}
# Keywords that lower it when no raising keyword is near.
ANTI = {
    "RU_PASSPORT": ("инн", "снилс", "бик", "р/с", "кпп"),
    "RU_INT_PASSPORT": ("инн", "кпп", "бик", "снилс", "телефон"),
    "PHONE_NUMBER": ("инн", "снилс", "паспорт", "бик", "р/с", "ip", "mac", "счёт", "счет"),
    "TG_CHAT_ID": ("инн", "снилс", "паспорт", "бик", "телефон", "тел.", "ip", "кпп"),
    "DATE_TIME": ("инн", "паспорт", "снилс"),
}
PENALTY = 0.25
RULED = frozenset("PERSON ORGANIZATION LOCATION RU_PASSPORT RU_INT_PASSPORT PHONE_NUMBER TG_CHAT_ID RU_INN RU_SNILS RU_DRIVER_LICENSE DATE_TIME".split())


def has_any(words: Column, keys: tuple[str, ...]) -> Column:
    """One search for all keys, which are literals."""
    return words.rlike("|".join(rf"\Q{k}\E" for k in keys)) if keys else F.lit(False)


def _rules(label: str, text: Column, e: Column) -> Column:
    """The rules that reject a span of this label."""
    bound = F.struct(F.trim(e["text"]).alias("frag"), checks.digits(e["text"]).alias("d"), window(text, e).alias("near"))
    return checks.let(bound, lambda x: _bound_rules(label, e, x["frag"], x["d"], x["near"]))


def _bound_rules(label: str, e: Column, frag: Column, d: Column, near: Column) -> Column:
    n = F.length(d)
    bad = F.lit(False)
    if label in ("PERSON", "ORGANIZATION", "LOCATION"):
        bad = F.contains(e["text"], F.lit("\n"))
    elif label == "RU_PASSPORT":
        bad = checks.inn10(d) | (~has_any(near, CONTEXT[label]) & has_any(near, ANTI[label]))
    elif label == "RU_INT_PASSPORT":
        bad = ~F.contains(near, F.lit("загран")) | ((n == 9) & F.substring(d, 1, 2).isin("04", "01", "00") & has_any(near, ("бик", "инн", "кпп")))
    elif label == "PHONE_NUMBER":
        shaped, prefixed = frag.rlike(checks.PHONE_SHAPE), frag.rlike(checks.PHONE_PREFIX)
        bad = frag.rlike(checks.IP_SHAPE) | frag.rlike(checks.MAC_SHAPE) | frag.rlike(checks.SNILS_SHAPE)
        bad = bad | (checks.snils(d) & (F.contains(near, F.lit("снилс")) | ~shaped) & ~prefixed)
        bad = bad | checks.inn10(d) | (n == 9) | ((n == 10) & ~shaped & ~prefixed) | (F.length(F.regexp_replace(frag, r"[^.]", "")) >= 2)
    elif label == "TG_CHAT_ID":
        channel = frag.rlike(checks.CHANNEL_SHAPE)
        bad = ~channel & (~has_any(near, CONTEXT[label]) | checks.inn(d) | checks.snils(d))
    elif label == "RU_INN":
        bad = ~checks.inn(d)
    elif label == "RU_SNILS":
        bad = ~checks.snils(d)
    elif label == "RU_DRIVER_LICENSE":
        bad = (F.length(F.regexp_replace(frag, r"[^\p{L}]", "")) < 2) | (n != 8)
    elif label == "DATE_TIME":
        bad = frag.rlike(r"^[0-9]{9,12}$")
    return bad


def rejected(label: str, text: Column, e: Column) -> Column:
    header = F.trim(e["text"]).startswith("===") | F.contains(e["text"], F.lit("\n==="))
    return header | F.coalesce(_rules(label, text, e), F.lit(False)) if label in RULED else header


def rescored(label: str, text: Column, e: Column, boost: float) -> Column:
    """The confidence after looking at the words around."""
    score = e["confidence"]
    raising, lowering = CONTEXT.get(label), ANTI.get(label)
    if raising or lowering:
        old = score
        score = checks.let(window(text, e), lambda near: F.when(has_any(near, raising or ()), F.least(old + boost, F.lit(1.0))).when(has_any(near, lowering or ()), F.greatest(old - PENALTY, F.lit(0.0))).otherwise(old))
    if label == "TG_CHAT_ID":
        score = F.when(F.trim(e["text"]).rlike(checks.CHANNEL_SHAPE), F.greatest(score, F.lit(0.95))).otherwise(score)
    return score


def judged(label: str, text: Column, spans: Column, config: PiiConfig) -> Column:
    """Spans of one label that are not rejected, rescored, and reach the label's threshold."""
    kept = F.filter(spans, lambda e: ~rejected(label, text, e))
    scored = F.transform(kept, lambda e: span(e["label"], e["text"], e["start"], rescored(label, text, e, config.context_boost), e["source"], e["end"]))
    return F.filter(scored, lambda e: e["confidence"] >= config.threshold_for(label))


def _of_label(spans: Column, label: str) -> Column:
    return F.filter(spans, lambda e: e["label"] == label)


def judge_mixed(text: Column, spans: Column, config: PiiConfig) -> Column:
    """The same for an array with spans of any labels, e.g. from an external model; unknown labels only meet the threshold."""
    known = sorted(config.active())
    parts = [judged(x, text, _of_label(spans, x), config) for x in known]
    return F.concat(*parts) if parts else empty()


def thresholds(config: PiiConfig, label: Column) -> Column:
    return lookup(config.effective_thresholds(), label, F.lit(config.pattern_threshold))
