"""Detection: one array column with every span of a text, resolved to disjoint spans. A projection, nothing else."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame
from veilspark.functions import fx as F

from veilspark.functions.names import name_stem
from veilspark.functions.spans import empty, hits, merge_persons, overlaps, resolve, span, union_spans
from veilspark.operators.context import judge_mixed, judged
from veilspark.operators.recognizers import RECOGNIZERS, RULES, Recognizer
from veilspark.plans.config import PiiConfig
from veilspark.plans.staging import staged


#: Cheap searches that a text must pass before any pattern of a label is tried.
NEEDS_DIGIT = frozenset("RU_INN RU_SNILS RU_PASSPORT RU_INT_PASSPORT RU_DRIVER_LICENSE RU_OMS RU_VEHICLE_PLATE TG_CHAT_ID GPS_COORDS PHONE_NUMBER RU_ACCOUNT RU_BIK IP_ADDRESS CREDIT_CARD IBAN_CODE DATE_TIME".split())
GUARDS = {"EMAIL_ADDRESS": lambda t: F.contains(t, F.lit("@")), "MAC_ADDRESS": lambda t: t.rlike(r"\p{XDigit}[:.-]\p{XDigit}"), "CRYPTO": lambda t: t.rlike(r"bc1|0x|[13]\w{25}")}
DIGIT, CYRILLIC = r"\p{Nd}\P{L}{0,8}\p{Nd}", r"[А-ЯЁ]"


def raw_spans(text: Column, config: PiiConfig, extra: tuple[Recognizer, ...] = (), has_digit: Column | None = None, has_cyrillic: Column | None = None) -> dict[str, Column]:
    """By label, the array of all matches; only patterns of active labels are part of the plan."""
    wanted = set(config.active())
    found: dict[str, list[Column]] = {}
    for r in (*RECOGNIZERS, *(RULES if config.ner_enabled else ()), *extra):
        if r.label in wanted:
            spans = r.spans(text, config)
            if r in RULES and has_cyrillic is not None:
                spans = F.when(has_cyrillic, spans).otherwise(empty())
            elif r in RECOGNIZERS and r.label in NEEDS_DIGIT and has_digit is not None:
                spans = F.when(has_digit, spans).otherwise(empty())
            elif r in RECOGNIZERS and r.label in GUARDS:
                spans = F.when(GUARDS[r.label](text), spans).otherwise(empty())
            found.setdefault(r.label, []).append(spans)
    return {k: F.concat(*v) if len(v) > 1 else v[0] for k, v in found.items()}


def name_stems(persons: Column) -> Column:
    tokens = F.flatten(F.transform(persons, lambda e: F.filter(F.regexp_extract_all(e["text"], F.lit(r"\p{L}+"), F.lit(0)), lambda t: F.length(t) >= 3)))
    return F.array_distinct(F.transform(tokens, name_stem))


def same_names(text: Column, persons: Column, stems: Column) -> Column:
    """Occurrences of the same names in other forms: words that share a name's stem, where no person is yet."""
    least = F.array_min(F.transform(persons, lambda e: e["confidence"]))
    words = F.filter(hits(text, r"(?U)\b[А-ЯЁA-Z][а-яёa-z]{2,}\b"), lambda h: F.array_contains(stems, name_stem(h["text"])))
    new = F.transform(words, lambda h: span("PERSON", h["text"], h["start"], F.least(F.lit(0.9), least * 0.95), "morpho"))
    return F.filter(new, lambda e: ~F.exists(persons, lambda p: overlaps(p, e)))


def with_spans(df: DataFrame, text: str = "text", config: PiiConfig = PiiConfig(), name: str = "spans", extra: tuple[Recognizer, ...] = (), external: str | None = None) -> DataFrame:
    """Add name: the array of disjoint spans of the text column, in order; empty for null and empty texts.

    external names an array column of spans of another detector, which are judged like the others. Each step is a
    projection of its own: Catalyst keeps an expensive expression that is read twice in its own projection, so no
    pattern is searched twice.
    """
    with contextlib.nullcontext() if extra else F.as_sql():  # other recognizers' validators work on columns
        return _with_spans(df, text, config, name, extra, external)


def add(df: DataFrame, columns: dict) -> DataFrame:
    return df.withColumns({k: F.column(v) for k, v in columns.items()})


def _with_spans(df: DataFrame, text: str, config: PiiConfig, name: str, extra: tuple[Recognizer, ...], external: str | None) -> DataFrame:
    own = lambda x: f"__{name}_{x}"
    t, before = F.col(text), df.columns
    out = add(df, {own("digit"): F.coalesce(t.rlike(DIGIT), F.lit(False)), own("cyrillic"): F.coalesce(t.rlike(CYRILLIC), F.lit(False))})
    found = raw_spans(t, config, extra, F.col(own("digit")), F.col(own("cyrillic")))
    out = add(out, {own(label): spans for label, spans in found.items()})
    persons = F.col(own("PERSON"))
    if "PERSON" in found and config.ner_enabled and config.morphology_enabled:
        some = F.size(persons) > 0
        out = add(out, {own("PERSON"): F.when(some, merge_persons(persons, t)).otherwise(empty())})
        out = add(out, {own("stems"): F.when(some, name_stems(persons))})
        out = add(out, {own("PERSON"): F.when(some, F.concat(persons, same_names(t, persons, F.col(own("stems"))))).otherwise(empty())})
    parts = [F.when(F.size(F.col(own(label))) > 0, judged(label, t, F.col(own(label)), config)).otherwise(empty()) for label in found]
    if external is not None:
        parts.append(judge_mixed(t, F.col(external), config))
    out = add(out, {own("all"): F.coalesce(F.concat(*parts) if parts else empty(), empty())})
    every = F.col(own("all"))
    resolved = union_spans(every, t) if config.mask_union else resolve(every)
    return add(out, {name: F.when(F.size(every) > 1, resolved).otherwise(every)}).select(*[c for c in before if c != name], name)


def exploded(df: DataFrame, key: str = "doc_id", spans: str = "spans") -> DataFrame:
    """One row per span: key, label, text, start, end, confidence, source.

    The arrays are written first: a generator right above the detection would make Catalyst copy it for every field.
    """
    return staged(df.select(key, spans), "spans").select(key, F.inline(spans))
