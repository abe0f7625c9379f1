"""The public plans: analyze, corpora, feature registry."""
