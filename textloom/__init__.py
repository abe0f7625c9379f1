"""Quantitative text features on Spark: DataFrame of texts in, one wide row of measures per text out.

Attributes load on first use, so that the rule modules can be imported without Spark.
"""

from __future__ import annotations

import importlib

_WHERE = {
    "analyze": "plans.analyze", "analyze_corpus": "plans.analyze", "analyze_text": "plans.analyze", "feature_keys": "plans.registry",
    "ngram_counts": "operators.ngrams", "ngram_matches": "operators.ngrams",
    "FeatureParams": "params", "segment_text": "sources.segments", "segment": "sources.segments", "read_corpus": "sources.corpus",
    "save_csv": "sources.sinks", "save_matrix": "sources.sinks", "describe_feature": "plans.registry",
    "LinguisticFeaturesError": "errors", "ModelNotFoundError": "errors", "MissingDependencyWarning": "errors", "ParagraphStructureWarning": "errors",
}
__all__ = list(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(importlib.import_module(f"textloom.{_WHERE[name]}"), name)
    raise AttributeError(name)
