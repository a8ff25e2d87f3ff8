"""Reply trees: reachable items, ancestors, depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import html_parts
from quillmark.operators.incremental import digest
from quillmark.session import cut

TEXT_CAP = 6000


def climbed(nodes: DataFrame) -> DataFrame:
    """id, top, depth of the nodes (id, up) whose way up ends, at a node without `up`; ids and ups are of one type.

    Pointer doubling: in each round a node's pointer goes on to where the node
    that it points to points, so ways double and the rounds are the logarithm
    of the longest. Only ways that haven't ended are joined. A round that ends
    none shows that the rest goes round in cycles. `up` has to be a node.
    """
    ways = cut(nodes.select("id", F.coalesce("up", "id").alias("at"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"), F.col("up").isNull().alias("ended")))
    left = ways.where("not ended").count()
    while left:
        on = ways.select(F.col("id").alias("at"), F.col("at").alias("beyond"), F.col("depth").alias("more"), F.col("ended").alias("ends"))
        further = ways.where("not ended").join(on, "at").select("id", F.col("beyond").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("ended"))
        ways = cut(ways.where("ended").union(further))
        before, left = left, ways.where("not ended").count()
        if left == before:
            break
    return ways.where("ended").select("id", F.col("at").alias("top"), "depth")


def under(items: DataFrame, roots: DataFrame) -> DataFrame:
    """id, root, depth of the items (id, kids) that roots (id) reach over kids; each once, cycles end.

    An item that several others hold hangs on the smallest of them; if that one
    isn't reached, on one that is.
    """
    held = items.select(F.col("id").alias("up"), F.explode("kids").alias("id")).distinct()
    nodes = items.select("id").distinct()
    found, start = None, roots.select("id", F.col("id").alias("root"), F.lit(0).alias("depth")).distinct()
    while True:
        parents = held.join(nodes.select(F.col("id").alias("up")), "up").groupBy("id").agg(F.min("up").alias("up"), F.count("*").alias("n"))
        open_ = nodes.join(start.select("id", "root", F.col("depth").alias("above")), "id", "left").join(parents, "id", "left")
        open_ = cut(open_.withColumn("up", F.when(F.col("root").isNull(), F.col("up"))))
        ends = open_.where("root is not null").select(F.col("id").alias("top"), "root", "above")
        got = climbed(open_.select("id", "up")).join(ends, "top").select("id", "root", (F.col("above") + F.col("depth")).alias("depth"))
        found = got if found is None else found.union(got)
        if not open_.where("n > 1").limit(1).count():
            return found
        found = cut(found)
        nodes = cut(nodes.join(found.select("id"), "id", "left_anti"))
        again = held.join(nodes, "id").join(found.select(F.col("id").alias("up"), "root", "depth"), "up")
        start = cut(again.groupBy("id").agg(F.min(F.struct((F.col("depth") + 1).alias("depth"), "root")).alias("s")).select("id", "s.root", "s.depth"))
        if not start.limit(1).count():
            return found


def reachable(items: DataFrame, roots: DataFrame) -> DataFrame:
    """id, depth of the items that roots (id) reach over kids."""
    return under(items, roots).select("id", "depth")


def depths(comments: DataFrame) -> DataFrame:
    """thread_id, reachable, depth: how many items hang on the thread's items without a stored parent, and how deep.

    Items of a cycle hang on none. An item that is stored twice with different
    parents hangs on the smaller one.
    """
    rows = comments.groupBy(F.struct("thread_id", "id").alias("id")).agg(F.min("parent_id").alias("parent_id"))
    rows = rows.withColumn("asked", F.struct(F.col("id.thread_id").alias("thread_id"), F.col("parent_id").alias("id")))
    nodes = rows.join(rows.select(F.col("id").alias("up")), F.col("asked") == F.col("up"), "left").select("id", "up")
    return climbed(nodes).groupBy("id.thread_id").agg(F.count("*").alias("reachable"), F.max("depth").alias("depth"))


def missing(items: DataFrame) -> DataFrame:
    """Kids that no item holds, with their parent."""
    return items.select(F.col("id").alias("parent"), F.explode("kids").alias("id")).join(items.select("id"), "id", "left_anti")


def ancestors(comments: DataFrame, cap: int = TEXT_CAP) -> DataFrame:
    """comments with their ancestors of the same thread: at most two, the older first, texts capped.

    Two joins suffice: the number of hops is fixed. A comment never counts as
    its own ancestor.
    """
    up = lambda n: comments.select(F.col("thread_id").alias(f"t{n}"), F.col("id").alias(f"id{n}"), F.col("parent_id").alias(f"up{n}"), F.left("text", F.lit(cap)).alias(f"text{n}"))
    out = comments.join(up(1), (F.col("thread_id") == F.col("t1")) & (F.col("parent_id") == F.col("id1")) & (F.col("id1") != F.col("id")), "left")
    out = out.join(up(2), (F.col("thread_id") == F.col("t2")) & (F.col("up1") == F.col("id2")) & (F.col("id2") != F.col("id")) & (F.col("id2") != F.col("id1")), "left")
    one = lambda n: F.when(F.col(f"id{n}").isNotNull(), F.struct(F.col(f"id{n}").alias("id"), F.col(f"text{n}").alias("text")))
    return out.select(*[comments[c] for c in comments.columns], F.array_compact(F.array(one(2), one(1))).alias("ancestors"))


def model_input(comments: DataFrame, threads: DataFrame, cap: int = TEXT_CAP) -> DataFrame:
    """thread_id, id, payload (JSON) and its digest: what a model is shown of each comment.

    Texts are plain. Those of the thread and of ancestors, which only give
    context, end after `cap` characters; the comment itself is shown whole, with
    its links. A comment without a stored thread has an empty title and text.
    """
    parsed = comments.withColumn("h", html_parts("text")).select("thread_id", "id", "parent_id", F.col("h.plain").alias("text"), F.col("h.links").alias("links"))
    own = threads.select(F.col("id").alias("thread_id"), "title", (html_parts("text")["plain"] if "text" in threads.columns else F.lit("")).alias("about"))
    rows = ancestors(parsed, cap).join(own, "thread_id", "left")
    shown = F.struct(
        F.coalesce("title", F.lit("")).alias("thread_title"),
        F.left(F.coalesce("about", F.lit("")), F.lit(cap)).alias("thread_text"),
        "ancestors",
        F.struct("text", "links").alias("current_comment"),
    )
    return rows.select("thread_id", "id", F.to_json(shown).alias("payload")).withColumn("digest", F.sha2("payload", 256))


def model_keys(inputs: DataFrame, backend: str, model: str, prompt: str, topics: list[str]) -> DataFrame:
    """inputs with cache_key: the answer depends on who is asked, by which prompt, for which topics, about what."""
    asked = {"backend": backend, "model": model, "prompt": prompt, "topics": "\n".join(sorted(topics))}
    rows = inputs.withColumns({f"asked_{k}": F.lit(v) for k, v in asked.items()})
    return rows.withColumn("cache_key", digest(*[f"asked_{k}" for k in asked], "payload")).drop(*[f"asked_{k}" for k in asked])
