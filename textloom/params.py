"""Parameters of the measures."""

from __future__ import annotations

from dataclasses import dataclass

from .vocab import SENTENCE_LENGTHS


@dataclass(frozen=True, slots=True)
class FeatureParams:
    """Window sizes, sample sizes, seeds and thresholds. A sentence threshold of None means the language's own."""

    mattr_window: int = 50
    mtld_threshold: float = 0.72
    mtld_min_tokens: int = 100
    hdd_sample_size: int = 42
    msttr_segment_size: int = 100
    vocd_sample_min: int = 35
    vocd_sample_max: int = 50
    vocd_num_samples: int = 100
    vocd_num_runs: int = 3
    vocd_min_tokens: int = 50
    vocd_random_seed: int = 42
    heaps_points: int = 20
    brunet_w_a: float = 0.172
    brunet_w_b: int = 20
    verb_suffix_window: int = 10
    verb_suffix_num_samples: int = 100
    verb_suffix_random_seed: int = 42
    kalyoncu_ttr_window: int = 500
    short_sent_threshold: int | None = None
    long_sent_threshold: int | None = None
    max_parse_depth: int = 20

    def check(self) -> None:
        """Raise ValueError for values that no text could be measured with."""
        for name in ("mattr_window", "hdd_sample_size", "msttr_segment_size", "kalyoncu_ttr_window"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive: {getattr(self, name)}")
        if self.heaps_points < 2:
            raise ValueError(f"heaps_points must be at least 2: {self.heaps_points}")
        if self.vocd_sample_min < 1 or self.vocd_sample_min > self.vocd_sample_max or self.vocd_num_samples < 1 or self.vocd_num_runs < 1:
            raise ValueError("Invalid voc-D parameters")


DEFAULT = FeatureParams()


def sentence_thresholds(params: FeatureParams, lang: str) -> tuple[int, int]:
    """Short and long sentence limits; each that isn't set is the language's."""
    short, long = SENTENCE_LENGTHS[lang]
    return (short if params.short_sent_threshold is None else params.short_sent_threshold, long if params.long_sent_threshold is None else params.long_sent_threshold)
