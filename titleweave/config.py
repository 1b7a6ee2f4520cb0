"""Settings of title matching."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    n_grams: int = 3
    max_characters: int = 255
    not_found: int = -1
    top_n_training: int = 10
    top_n_predicting: int = 100
    words: int = 15  # words of a reference title that get features
    ratio_threshold: float = 94.0
    probability_threshold: float = 0.9
    false_positive_penalty: float = 5.0
    evaluation_generated: float = 0.05
    evaluation_negative: float = 0.1
    evaluation_positive: float = 0.05
    least_generated_length: int = 10
    seed: str = "7"
    delimiter: str = "|"
    #: Boosting rounds of the model.
    rounds: int = 30
    depth: int = 5
    step: float = 0.1


DEFAULT = Config()
#: Kinds of training pairs.
GENERATED, NEGATIVE, POSITIVE = 1, 2, 3
