"""Sentiment, strength and topics of a mention's context, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.patterns import standing_in
from quillmark.sources.config import topic_words

# What a reader writes of a work, strongest statement first.
NEGATIVE = ["overrated", "disappointing", "terrible", "hated", "avoid", "not recommend", "don't recommend", "wouldn't recommend", "do not recommend", "not worth", "didn't like", "did not like"]
STRONG = ["highly recommended?", "must.read", "best book", "essential", "strongly recommended?", "changed my", "recommend(?:ed)?"]
POSITIVE = ["loved", "enjoyed", "great", "excellent", "favorite", "favourite", "helpful", "useful", "clever", "good book"]
# Fixed values: (sentiment, strength) of each label.
LABELS = {"negative": (-0.8, 0.0), "recommended": (0.9, 0.95), "positive": (0.6, 0.65), "neutral": (0.0, 0.2)}


def says(text: Column, phrases: list[str]) -> Column:
    return text.rlike(rf"\b(?:{'|'.join(phrases)})\b")


def label(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(says(low, NEGATIVE), "negative").when(says(low, STRONG), "recommended").when(says(low, POSITIVE), "positive").otherwise("neutral")


def _number(label_: Column, k: int) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, pair in LABELS.items():
        out = out.when(label_ == name, F.lit(pair[k]))
    return out


def sentiment(label_: Column) -> Column:
    return _number(label_, 0)


def strength(label_: Column) -> Column:
    return _number(label_, 1)


def label_of(sentiment_: Column, strength_: Column) -> Column:
    """The label that numbers stand for."""
    return F.when(sentiment_ < 0, "negative").when(sentiment_ == 0, "neutral").when(strength_ >= 0.9, "recommended").otherwise("positive")


def is_positive(strength_: str | Column = "recommendation_strength", sentiment_: str | Column = "sentiment") -> Column:
    s, t = (F.col(c) if isinstance(c, str) else c for c in (strength_, sentiment_))
    return (s >= 0.6) & (t > 0)


def ascii_normal(text: Column) -> Column:
    """normal() for text of ASCII letters, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+", " "))


def tag_topics(rows: DataFrame, text: str, key: str, confidence: float = 0.8) -> DataFrame:
    """key, topic, confidence: topics whose words stand in the normalised text.

    One pass over each text finds all words of all topics, so the dimension's
    rows are neither shuffled nor crossed with the texts.
    """
    words = [(word, topic) for topic, word in map(tuple, topic_words(rows.sparkSession).collect())]  # a fixed list
    found = rows.select(key, standing_in(F.col(text), words).alias("topics"))
    return found.select(key, F.explode("topics").alias("topic"), F.lit(confidence).alias("confidence"))
