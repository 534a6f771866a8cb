"""Training-data operators: deduplication, filtering, extraction, tokens and scores.

Nothing outside this folder imports it. ``queries`` registers one query per operator.
"""
