"""Operators for training-data pipelines: text quality, language, toxicity, deduplication, decontamination, packing.

Nothing outside this folder imports it; ``queries.py`` lists what the driver runs.
"""
