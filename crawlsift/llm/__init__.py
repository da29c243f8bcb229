"""Operators of a training-data pipeline: quality, toxicity, near copies, decontamination, mixing, tokens, language models, archives."""
