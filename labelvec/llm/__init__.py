"""Operators for training text, their registered queries and the stages of the corpus pipeline."""
