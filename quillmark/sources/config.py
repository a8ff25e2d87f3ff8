"""Dimensions that come from configuration: topics, aliases, ambiguous titles, reviewed authors.

All are small fixed lists, so broadcasting them is safe at any size of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Each topic and the words that name it.
TOPICS = {
    "distributed-systems": ["distributed systems", "distributed computing", "consensus", "replication"],
    "databases": ["database", "databases", "sql", "data intensive", "data-intensive"],
    "systems-programming": ["systems programming", "rust", "operating systems", "low-level"],
    "programming-languages": ["programming languages", "compiler", "compilers", "lisp", "scheme"],
    "machine-learning": ["machine learning", "deep learning", "neural networks"],
    "ai": ["artificial intelligence", "ai", "llm"],
    "mathematics": ["mathematics", "math", "algebra", "calculus", "proofs"],
    "statistics": ["statistics", "statistical", "probability", "bayesian"],
    "finance": ["finance", "investing", "investment"],
    "economics": ["economics", "economic", "markets"],
    "startups": ["startup", "startups", "entrepreneur"],
    "management": ["management", "manager", "leadership"],
    "software-design": ["software design", "architecture", "refactoring", "programmer", "programming"],
    "engineering": ["engineering", "engineer"],
    "philosophy": ["philosophy", "philosophical", "ethics"],
    "psychology": ["psychology", "cognitive", "behavior"],
    "history": ["history", "historical"],
    "biography": ["biography", "memoir", "autobiography"],
    "science-fiction": ["science fiction", "sci-fi", "dune", "space opera"],
    "fiction": ["fiction", "novel", "novels"],
}
# Fixed values: (title, author, other ways to write it).
ALIASES = [
    ("Designing Data-Intensive Applications", "Martin Kleppmann", ["DDIA", "Designing Data Intensive Applications", "Kleppmann's book", "Kleppmann’s book"]),
    ("Structure and Interpretation of Computer Programs", "Harold Abelson", ["SICP"]),
    ("The Art of Computer Programming", "Donald Knuth", ["TAOCP"]),
    ("The Pragmatic Programmer", "David Thomas", ["Pragmatic Programmer"]),
    ("Gödel, Escher, Bach", "Douglas Hofstadter", ["GEB", "Godel Escher Bach", "Gödel Escher Bach"]),
    ("Dune", "Frank Herbert", []),
    ("The Rust Programming Language", "Steve Klabnik", ["the Rust book"]),
]
# Words that name a book only with an author or a link.
AMBIGUOUS = ["It", "We", "Us", "You", "Her", "Go", "Up", "On", "Python", "Rust", "Java", "SQL", "AI", "Code"]
# One author's names, the one to show first.
AUTHOR_NAMES = [
    ["Fyodor Dostoevsky", "Fyodor Dostoyevsky", "Fiódor Dostoievski", "Фёдор Михайлович Достоевский", "Федор Михайлович Достоевский"],
    ["Haruki Murakami", "村上春樹", "村上春树", "Murakami Haruki"],
    ["Cixin Liu", "刘慈欣", "Liu Cixin"],
    ["Katherine Addison", "Sarah Monette", "Sarah Elizabeth Monette"],
    ["Charles T. Munger", "Charlie Munger"],
    ["Andrew S. Grove", "Andy Grove", "Andrew Grove"],
]
# Words that a search leaves out.
STOPWORDS = {"book", "books", "about", "on", "the", "a", "an", "for", "i", "want"}
MOST_SEARCH_WORDS = 20


def topics(spark: SparkSession) -> DataFrame:
    """id, name, description: a row for each topic."""
    return spark.createDataFrame([(i, name, name.replace("-", " ")) for i, name in enumerate(TOPICS, 1)], "id long, name string, description string")


def topic_words(spark: SparkSession) -> DataFrame:
    from quillmark.functions.text import normal

    return spark.createDataFrame([(t, w) for t, words in TOPICS.items() for w in sorted({normal(x) for x in words})], "topic string, word string")


# Works whose identity was checked by hand: (work, title, authors, titles that mean it).
REVIEWED_WORKS = [
    ("/works/OL272063W", "The Brothers Karamazov", ["Fyodor Dostoevsky"], ["The Brothers Karamazov"]),
    ("/works/OL15029001W", "1Q84", ["Haruki Murakami"], ["1Q84"]),
    ("/works/OL17270804W", "The Goblin Emperor", ["Katherine Addison"], ["The Goblin Emperor"]),
    ("/works/OL16314245W", "The Dark Forest", ["Cixin Liu"], ["The Dark Forest", "The Dark Forest (The Three-Body Problem Series Book 2)"]),
    ("/works/OL16809803W", "The Goldfinch", ["Donna Tartt"], ["The Goldfinch"]),
    ("/works/OL3737036W", "Thinking in Systems", ["Donella H. Meadows"], ["Thinking in Systems", "Thinking in Systems: A Primer"]),
    ("/works/OL77746W", "Anne of Green Gables", ["Lucy Maud Montgomery"], ["Anne of Green Gables"]),
    ("/works/OL679360W", "American Gods", ["Neil Gaiman"], ["American Gods"]),
    ("/works/OL8928012W", "Poor Charlie's Almanack", ["Charles T. Munger"], ["Poor Charlie's Almanack"]),
    ("/works/OL15701417W", "The Pale King", ["David Foster Wallace"], ["The Pale King"]),
    ("/works/OL20764348W", "Beyond Tube-and-Wing", ["Bruce I. Larrimer"], ["Beyond Tube-and-Wing", "Beyond Tube-and-Wing: The X-48 Blended Wing-Body and NASA's Quest to Reshape Future Transport Aircraft"]),
    ("/works/OL20153382W", "Say Nothing", ["Patrick Radden Keefe"], ["Say Nothing", "Say Nothing: A True Story of Murder and Memory in Northern Ireland"]),
    ("/works/OL1976779W", "Deadly Quicksilver Lies", ["Glen Cook"], ["Deadly Quicksilver Lies", "Deadly Quicksilver Lies (Garrett Files)"]),
    ("/works/OL2355832W", "Only the Paranoid Survive", ["Andrew S. Grove"], ["Only the Paranoid Survive"]),
    ("/works/OL28091094W", "Palo Alto", ["Malcolm Harris"], ["Palo Alto"]),
]
# Works that an author's name alone must not lead to.
EXCLUDED_WORKS = [("/works/OL20185071W", ["James S. A. Corey"])]


def reviewed_works(spark: SparkSession) -> DataFrame:
    """reviewed_key, review_title, review_authors, review_titles (normal forms)."""
    from quillmark.functions.text import normal

    rows = [(k, t, a, sorted({normal(x) for x in titles})) for k, t, a, titles in REVIEWED_WORKS]
    return spark.createDataFrame(rows, "reviewed_key string, review_title string, review_authors array<string>, review_titles array<string>")


def excluded_works(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXCLUDED_WORKS, "excluded_key string, excluded_authors array<string>")
