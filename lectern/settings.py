"""Thresholds of the two profiles. Builders take one of these; fields can be overridden by spark.conf."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Thresholds that results depend on."""

    profile: str = "notebook"
    near_dup_jaccard: float = 0.50
    near_dup_window: int = 2
    near_dup_min_words: int = 5
    repetition_share: float = 0.5
    repetition_min_slides: int = 5
    recognizer_threshold: float = 0.35
    heading_boost: float = 0.15
    keyphrase_max: int = 25
    candidate_top: int = 30
    candidate_score: float = 0.3
    phrase_dedup_cosine: float = 0.85
    fallback_score: float = 0.40
    fallback_max_phrases: int = 1
    fallback_min_words: int = 20
    evidence_cosine: float = 0.65
    evidence_cosine_fallback: float = 0.50
    confidence: float = 0.70

    @classmethod
    def of(cls, profile: str = "notebook", spark: SparkSession | None = None) -> Settings:
        """The profile's settings, with spark.conf entries `lectern.<field>` on top."""
        out = cls(profile="backend", repetition_min_slides=2, heading_boost=0.20, evidence_cosine=0.75, evidence_cosine_fallback=0.75) if profile == "backend" else cls()
        if spark is None:
            return out
        found = {f.name: spark.conf.get(f"lectern.{f.name}", None) for f in fields(cls)}
        return replace(out, **{k: type(getattr(out, k))(v) for k, v in found.items() if v is not None})
