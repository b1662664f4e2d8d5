"""Operators of a training-data pipeline: dedup, tokenizing, language, decontamination,
quality, toxicity, chat repair and vector near-duplicates.

Nothing else in the library imports this subpackage. ``queries.py`` registers one query
per operator; the operators keep general interfaces and return texts, spans or pairs.
"""
