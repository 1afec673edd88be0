"""What to look for and how strictly; compiled into column expressions on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from veilspark.functions.labels import BY_NAME, LABELS, NER_LABELS

NER_FALLBACK, PATTERN_FALLBACK = 0.35, 0.5


@dataclass(frozen=True)
class PiiConfig:
    enabled: tuple[str, ...] = tuple(x.name for x in LABELS)
    ner_enabled: bool = True
    morphology_enabled: bool = True
    canonical_persons: bool = True
    ner_threshold: float = NER_FALLBACK
    pattern_threshold: float = PATTERN_FALLBACK
    overrides: dict[str, float] = field(default_factory=dict)
    language: str = "ru"
    #: options beyond parity, all off: the official 12-digit rule, masking the union of overlapping spans, persons by full
    #: name, scores of 1.0 for validated matches, and a context boost that lets weak patterns pass
    inn12_official: bool = False
    mask_union: bool = False
    strict_persons: bool = False
    validator_score_one: bool = False
    context_boost: float = 0.15

    def threshold_for(self, label: str) -> float:
        if label in self.overrides:
            return self.overrides[label]
        if label in BY_NAME:
            return BY_NAME[label].threshold
        return self.ner_threshold if label in NER_LABELS else self.pattern_threshold

    def effective_thresholds(self) -> dict[str, float]:
        return {x: self.threshold_for(x) for x in self.active()}

    def active(self) -> tuple[str, ...]:
        return tuple(x for x in self.enabled if self.ner_enabled or x not in NER_LABELS)

    def with_threshold(self, label: str, value: float) -> PiiConfig:
        if not 0 <= value <= 1:
            raise ValueError(f"a threshold lies in [0, 1], not {value}")
        return replace(self, overrides={**self.overrides, label: float(value)})

    def enable(self, label: str) -> PiiConfig:
        return self if label in self.enabled else replace(self, enabled=(*self.enabled, label))

    def disable(self, label: str) -> PiiConfig:
        return replace(self, enabled=tuple(x for x in self.enabled if x != label))
