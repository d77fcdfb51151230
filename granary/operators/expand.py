"""Extending questions by domain phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.config import DEFAULT, Settings


def expanded(question: Column, settings: Settings = DEFAULT) -> Column:
    """The question and, in order, the phrase of every keyword that occurs in it, also within words."""
    low = F.lower(question)
    phrases = [F.when(F.contains(low, F.lit(word)), F.lit(phrase)) for word, phrase in settings.expansions]
    return F.when(question.isNotNull(), F.concat_ws(" ", question, *phrases))
