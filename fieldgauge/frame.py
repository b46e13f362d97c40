"""Fluent entry point over the scoring and comparison operators."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .operators import compare, scoring
from .schema import ScoringConfig


@dataclass(frozen=True)
class EvalFrame:
    """Predictions, truth and schema leaves of one evaluation, as lazy DataFrames."""
    predictions: DataFrame
    truth: DataFrame
    leaves: DataFrame

    def score(self, config: ScoringConfig = ScoringConfig(), extractions: DataFrame | None = None) -> "Scored":
        return Scored(scoring.score_fields(self.truth, self.predictions, self.leaves, config, extractions), extractions)


@dataclass(frozen=True)
class Scored:
    fields: DataFrame
    extractions: DataFrame | None = None

    def documents(self) -> DataFrame:
        return scoring.document_metrics(self.fields)

    def metrics(self) -> DataFrame:
        return scoring.run_metrics(self.fields, self.extractions)

    def by_field(self) -> DataFrame:
        return scoring.field_metrics(self.fields)

    def compare(self, other: "Scored") -> DataFrame:
        return compare.compare_fields(self.fields, other.fields)
