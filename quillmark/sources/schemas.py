"""Tables of the library. Schemas are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_PLAIN = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _type(name: str) -> T.DataType:
    if name.startswith("array<"):
        return T.ArrayType(_type(name[6:-1]))
    if name.startswith("map<string,"):
        return T.MapType(T.StringType(), _type(name[11:-1]))
    return _PLAIN[name]


def _schema(text: str) -> T.StructType:
    """From "name type, name type"; unlike Spark's own reader it needs no session."""
    return T.StructType([T.StructField(n, _type(t)) for n, t in (x.split() for x in text.split(", "))])


THREADS = _schema("id long, title string, url string, author string, created_at long, score int, descendants int, last_fetched_at timestamp")
COMMENTS = _schema("id long, thread_id long, parent_id long, author string, text string, created_at long, last_fetched_at timestamp, processed_hash string")
BOOKS = _schema(
    "id long, canonical_title string, normalized_title string, authors array<string>, publication_year int, description string, cover_url string,"
    " openlibrary_id string, isbn_10 array<string>, isbn_13 array<string>, resolution_version int, review_digest string"
)
MENTIONS = _schema(
    "id long, book_id long, comment_id long, thread_id long, raw_mention string, normalized_mention string, context_text string,"
    " extraction_confidence double, resolution_confidence double, recommendation_strength double, sentiment double, status string"
)
MENTION_TAGS = _schema("mention_id long, tag_id long, confidence double")
TAGS = _schema("id long, name string, description string")
CHECKPOINTS = _schema("thread_id long, raw_complete boolean, processed_version string, completed_at timestamp")
RUNS = _schema("id long, command string, started_at timestamp, finished_at timestamp, status string, metrics map<string,long>, error string")
#: Items of a discussion as its service gives them: a story or a comment.
ITEMS = _schema("id long, type string, by string, time long, title string, url string, text string, score int, descendants int, kids array<long>, parent long, deleted boolean, dead boolean")
#: Candidates of a catalogue search, and its works and authors.
CANDIDATES = _schema("key string, title string, author_name array<string>, first_publish_year int, cover_i long, isbn array<string>, subject array<string>")
WORKS = _schema("key string, title string, description string, author_keys array<string>, covers array<long>")
AUTHORS = _schema("key string, name string")
