"""Line dedup on levelled sorted runs of line hashes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import Workspace, table

#: What is stripped from a line's ends to get its key.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    """128 bits: two 64-bit hashes of the key with different seeds."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Sorted runs of (line hash, documents that hold it, largest doc_id), kept in levels.

    add() writes a batch of documents as a run of level 0. Once a level has
    `fanout` runs, they are merged into one run of the next level, so that a
    line hash is rewritten once for each level and the runs stay few. Runs hold
    counts that add up, so a merge is a sum and a maximum. Every batch has to
    hold documents of its own: a doc_id in two batches would count twice.
    """

    def __init__(self, ws: Workspace, fanout: int = 4) -> None:
        self.ws, self.fanout, self.levels, self.made = ws, fanout, [[]], 0

    def _write(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.made += 1
        name = f"run-{self.made}"
        self.levels[level].append((name, self.ws.save(run.repartitionByRange("h1").sortWithinPartitions("h1", "h2"), name)))
        if len(self.levels[level]) >= self.fanout:
            self.compact(level)

    def compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        self._write(self._merged([r for _, r in old]), level + 1)
        for name, _ in old:
            self.ws.drop(name)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def add(self, lines: DataFrame) -> None:
        """lines: doc_id, h1, h2. A document that holds a line often counts once."""
        once = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        self._write(once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")), 0)

    def held(self, lines: DataFrame, how: str = "left_semi") -> DataFrame:
        """The lines (h1, h2 and more) that a run holds, or with "left_anti" those that none does: merge joins with the sorted runs, newest first."""
        runs = [r.select("h1", "h2") for level in self.levels for _, r in reversed(level)]
        if how == "left_anti":
            for r in runs:
                lines = lines.join(r, ["h1", "h2"], "left_anti")
            return lines
        out = lines.limit(0)
        for r in runs:
            out = out.unionByName(lines.join(r, ["h1", "h2"], "left_semi"))
        return out.distinct() if len(runs) > 1 else out

    def frequent(self, min_docs: int) -> DataFrame:
        runs = [r for level in self.levels for _, r in level]
        merged = self._merged(runs) if len(runs) > 1 else runs[0]
        return merged.where(F.col("n_docs") >= min_docs)


def dedup_lines(
    docs: DataFrame, ws: Workspace, *, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 4, salts: int = 8
) -> DataFrame:
    """doc, n_lines, n_dropped and kept_text of every row of docs; doc is the row itself, as a struct.

    A line's key is the line without white space at its ends, A-Z in lower
    case. Keys of min_chars or more that min_docs or more documents hold lose
    all their lines, but for those in the largest doc_id that holds the key.

    The hashes and places of all long lines are written once, in `batches` by
    doc_id. Each batch adds its sorted run to the levelled runs. Then the
    batches' lines are joined with the runs' frequent hashes: the places of what
    matches and isn't in the last document are dropped. The frequent side is
    copied to `salts` salts, so that a line that a third of all documents hold
    is dealt over that many tasks.

    Null text is one empty line. Rows with the same doc_id count as one
    document, and each gives a row of its own, by its own text. Rows whose
    doc_id is null keep all their lines and count for no key. Very long texts
    cost time in proportion to their lines. Columns of docs may have any name.
    An empty table gives an empty table.
    """
    rows = keyed(docs)
    lines = long_lines(rows, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    lines = ws.save(lines, "lines")
    runs = LineRuns(ws, fanout)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    frequent = runs.frequent(min_docs).select("h1", "h2", "last_doc", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("h2", "doc_id"), F.lit(salts)).cast("int"))
    return without(rows, salted.join(frequent, ["h1", "h2", "salt"]).where(F.col("doc_id") < F.col("last_doc")))


BY = ["doc_id", "key", "key_too"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc (the row as a struct), BY (doc_id and 128 bits of the text), and text, empty for null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), "doc_id", F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("key_too"), text.alias("text"))


def long_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """BY, place, h1, h2 of the lines with a key of min_chars or more."""
    keys = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("place"), line_key(x).alias("k")))
    long = F.filter(keys, lambda x: F.char_length(x["k"]) >= min_chars)
    lines = rows.where("doc_id is not null").select(*BY, F.explode(F.transform(long, lambda x: F.struct(x["place"], key_hash(x["k"]).alias("h")))).alias("x"))
    return lines.select(*BY, "x.place", "x.h.h1", "x.h.h2")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """doc, n_lines, n_dropped and kept_text of keyed() rows after the lines at the given places (BY, place) are dropped."""
    drops = dropped.groupBy(*BY).agg(F.collect_list("place").alias("drops"))
    both = rows.join(drops, BY, "left").withColumn("lines", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.transform(F.array(F.struct(F.col("lines").alias("lines"), stay.alias("stay"))), lambda r: F.transform(r["stay"], lambda i: F.get(r["lines"], i)))  # an array of one: both are made once
    both = both.withColumn("kept", F.when(F.col("drops").isNotNull(), F.get(kept, F.lit(0))))
    n = F.size("lines").cast("long")
    none = F.col("drops").isNull()
    left = F.when(none, F.lit(0).cast("long")).otherwise(n - F.size("kept"))
    return both.select("doc", n.alias("n_lines"), left.alias("n_dropped"), F.when(none, F.col("text")).otherwise(F.array_join("kept", "\n")).alias("kept_text"))


def dedup_batch(docs: DataFrame, runs: LineRuns, ws: Workspace, *, min_chars: int = 20) -> DataFrame:
    """As dedup_lines(), for documents that arrive batch by batch: long lines that an earlier batch held are dropped.

    The batch anti-joins the runs of the batches before, and adds what they
    don't hold as a run of its own. Within a batch lines stay.
    """
    rows = keyed(docs)
    name = f"batch-{runs.made}"
    lines = ws.save(long_lines(rows, min_chars), name)
    old = runs.held(lines)
    out = ws.save(without(rows, old), f"{name}-kept")
    runs.add(runs.held(lines, "left_anti"))
    return out


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "op10"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
l as (
  select doc_id, i, line,
    translate(trim(line, E' \t\n\x0B\x0C\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(text, E'\n')) as line, generate_subscripts(string_split(text, E'\n'), 1) as i from d)
),
f as (
  select k, max(doc_id) as last_doc from l where length(k) >= 20
  group by k having count(distinct doc_id) >= 3
),
m as (select l.*, f.k is not null and l.doc_id < f.last_doc as dropped from l left join f on l.k = f.k)
select doc_id, count(*) as n_lines, cast(sum(case when dropped then 1 else 0 end) as bigint) as n_dropped,
  sha256(coalesce(string_agg(case when not dropped then line end, E'\n' order by i), '')) as kept_sha256
from m group by doc_id
"""
