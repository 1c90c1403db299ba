"""Operators for preparing training text: dedup, scoring, language, tokens, decontamination.

One module per operator; ``registry`` holds their queries and the SQL that gives the same rows.
"""
