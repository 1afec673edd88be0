"""The label dimension: Russian name, generic placeholder, priority in conflicts, default threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from veilspark.functions import fx as F


@dataclass(frozen=True)
class Label:
    name: str
    ru: str
    placeholder: str
    priority: int
    threshold: float


# Labels, names, placeholders, priorities and thresholds must be these for equal results.
LABELS = (
    Label("EMAIL_ADDRESS", "Email", "<EMAIL>", 100, 0.50),
    Label("CREDIT_CARD", "Кредитная карта", "<BANK_CARD>", 98, 0.50),
    Label("MAC_ADDRESS", "MAC-адрес", "<MAC>", 96, 0.50),
    Label("IP_ADDRESS", "IP-адрес", "<IP>", 94, 0.50),
    Label("GPS_COORDS", "GPS-координаты", "<GEO>", 93, 0.50),
    Label("RU_SNILS", "СНИЛС", "<SNILS>", 90, 0.50),
    Label("RU_INN", "ИНН", "<INN>", 88, 0.50),
    Label("RU_ACCOUNT", "Расчётный счёт", "<ACCOUNT>", 86, 0.55),
    Label("RU_OMS", "Полис ОМС", "<OMS>", 85, 0.60),
    Label("RU_BIK", "БИК", "<BIK>", 84, 0.55),
    Label("RU_VEHICLE_PLATE", "Госномер", "<CAR_PLATE>", 83, 0.50),
    Label("RU_DRIVER_LICENSE", "Вод. удостоверение", "<DRIVER_LICENSE>", 82, 0.55),
    Label("CRYPTO", "Криптокошелёк", "<WALLET>", 80, 0.50),
    Label("IBAN_CODE", "IBAN", "<IBAN>", 79, 0.50),
    Label("EME_IMEI", "IMEI", "<IMEI>", 75, 0.60),
    Label("RU_PASSPORT", "Паспорт РФ", "<PASSPORT_RF>", 70, 0.55),
    Label("PHONE_NUMBER", "Телефон", "<PHONE>", 60, 0.55),
    Label("TG_CHAT_ID", "Telegram ID", "<TG_CHAT_ID>", 58, 0.60),
    Label("RU_INT_PASSPORT", "Загранпаспорт", "<PASSPORT_INT>", 55, 0.70),
    Label("PERSON", "ФИО", "<PERSON>", 50, 0.35),
    Label("ORGANIZATION", "Организация", "<ORG>", 48, 0.40),
    Label("LOCATION", "Адрес", "<LOC>", 45, 0.40),
    Label("GPE", "Город/Страна", "<LOC>", 44, 0.40),
    Label("DATE_TIME", "Дата", "<DATE>", 30, 0.65),
    Label("NORP", "Национальность", "<GROUP>", 25, 0.50),
)
BY_NAME = {x.name: x for x in LABELS}
DEFAULT_PRIORITY = 10
NER_LABELS = ("PERSON", "ORGANIZATION", "LOCATION", "GPE", "DATE_TIME", "NORP")
NORMALISED = {"PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "LOCATION", "GPE": "LOCATION", "DATE": "DATE_TIME", "TIME": "DATE_TIME", "NRP": "NORP"}


def lookup(values: dict[str, object], label: Column, default: Column) -> Column:
    """values[label], or default."""
    if not values:
        return default
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[label], default)


def normalised(label: Column) -> Column:
    return lookup(NORMALISED, label, label)


def russian(label: Column) -> Column:
    return lookup({x.name: x.ru for x in LABELS}, label, label)


def generic_placeholder(label: Column) -> Column:
    return lookup({x.name: x.placeholder for x in LABELS}, label, F.concat(F.lit("<"), label, F.lit(">")))


def priority(label: Column) -> Column:
    return lookup({x.name: x.priority for x in LABELS}, label, F.lit(DEFAULT_PRIORITY))
