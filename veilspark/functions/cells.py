"""Spreadsheet cells: canonical strings, dictionaries over cells, fragments and heuristics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.operators.masking import dictionary_rewrite

PIPE = " | "
# Header words that are never personal data.
HEADER_WORDS = ("компания", "контакт", "клиент", "дата", "сумма", "долг", "фио", "имя", "название", "организация", "телефон", "email", "e-mail", "адрес", "инн", "примечание", "комментарий")
LEGAL_FORMS = r"^(?:ООО|ОАО|АО|ЗАО|ПАО|ИП|НКО|ФГУП|ГУП)(?U)\b"


def cell_string(value: Column, kind: Column) -> Column:
    """The text of a cell from its raw string and type (none, bool, datetime, date, float, int, str).

    Booleans are да/нет; dates dd.MM.yyyy, with HH:mm unless it is midnight; integral floats lose their fraction.
    """
    moment = F.try_to_timestamp(value)
    midnight = F.date_format(moment, "HH:mm:ss") == "00:00:00"
    number = value.try_cast("double")
    return (
        F.when(value.isNull() | (kind == "none"), "")
        .when(kind == "bool", F.when(F.lower(value).isin("true", "1"), "да").otherwise("нет"))
        .when(kind == "datetime", F.when(midnight, F.date_format(moment, "dd.MM.yyyy")).otherwise(F.date_format(moment, "dd.MM.yyyy HH:mm")))
        .when(kind == "date", F.date_format(moment, "dd.MM.yyyy"))
        .when((kind == "float") & (number == F.floor(number)), F.format_string("%.0f", number))
        .when(kind.isin("float", "int"), value)
        .otherwise(F.trim(value))
    )


def pipe_fragments(text: Column) -> Column:
    """The parts of a row's text between " | ", trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r" \| ", -1), lambda p: F.trim(p)), lambda p: p != "")


def is_junk(surface: Column) -> Column:
    t = F.trim(surface)
    return (F.length(t) < 2) | F.contains(t, F.lit("===")) | F.contains(t, F.lit("\n")) | F.lower(t).isin(*HEADER_WORDS)


def looks_like_org(text: Column) -> Column:
    return F.upper(F.trim(text)).rlike(LEGAL_FORMS) | F.contains(text, F.lit("«")) | F.contains(text, F.lit('"'))


def rewritten_cell(value: Column, is_formula: Column, mapping: Column) -> Column:
    """A cell with the dictionary applied; null cells and formulas stay."""
    return F.when(value.isNull() | F.coalesce(is_formula, F.lit(False)) | value.startswith("="), value).otherwise(dictionary_rewrite(value, mapping))


def norm(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def covers_cell(span_text: Column, cell: Column) -> Column:
    """Whether a span stands for its whole cell: equal, part of it, or around it."""
    a, b = norm(span_text), norm(cell)
    return (a == b) | F.contains(b, a) | F.contains(a, b)
