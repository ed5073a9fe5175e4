"""Operators for training-data pipelines: extraction, search, sharding, decontamination, similarity
joins, toxicity, archives, personal data, tokenisation and line deduplication."""
