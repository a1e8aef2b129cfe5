"""Search without a scan: entries and postings of their pieces of three characters as written tables, which a query reads by its own pieces.

The postings are plain Parquet, each file sorted by piece and written with delta-encoded blocks of numbers, so that min/max figures of row groups and
pages leave out the pieces that a query doesn't have. Where few entries hold all pieces, only
these are verified; where many do, a scan of all texts costs less than to bring places and texts together, and gives the same."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_score, searchable, snippet

#: Characters of a piece; entries of a block, within which postings count; blocks up to which a query names those it reads, and candidates
#: in them up to which these are sent to the scan.
PIECE, BLOCK, NAMED, SENT = 3, 4096, 1000, 100_000

#: Characters that are cut into pieces at once.
CUT = 1 << 20

COLUMNS = ("id", "kind", "title", "subtitle", "body", "course_id", "bonus", "hay")


def entity(rows: DataFrame, mark: str, key: str, kind: Column, title: Column, fields: Sequence[Column], subtitle: Sequence[Column] = (), body: Column | None = None, bonus: Column | int = 0) -> DataFrame:
    """Rows of one kind of thing, ready for an index: what is searched are its fields, which the hit shows as title, subtitle and a part of body.

    rows: course_id besides what the columns name. Null and empty fields are left out; a body of null gives no snippet. bonus is added to the
    score of a hit."""
    text = lambda c: c.cast("string")
    parts = F.filter(F.array(*map(text, subtitle)), lambda x: x.isNotNull() & (x != "")) if subtitle else F.array().cast("array<string>")
    return rows.select(
        F.concat_ws(":", F.lit(mark), text(F.col(key))).alias("id"),
        kind.alias("kind"),
        text(title).alias("title"),
        F.array_join(parts, " · ").alias("subtitle"),
        (F.lit(None) if body is None else body).cast("string").alias("body"),
        text(F.col("course_id")).alias("course_id"),
        (F.lit(bonus) if isinstance(bonus, int) else bonus).cast("int").alias("bonus"),
        searchable(*map(text, fields)).alias("hay"),
    )


def scanned(entries: DataFrame, query: str, limit: int = 40, course_id: str | None = None) -> DataFrame:
    """The best hits of a query among all entries (of one course, where that is named): id, kind, title, subtitle, course_id, score and snippet.

    A hit holds every word of the query. Best are the highest score, then title, then id; a query without words hits nothing."""
    of = entries if course_id is None else entries.filter(F.col("course_id") == course_id)
    hits = of.withColumn("found", search_score(query, F.col("hay"))).filter("found > 0").withColumn("score", F.col("found") + F.col("bonus"))
    best = hits.orderBy(F.desc("score"), "title", "id").limit(limit)
    return best.select("id", "kind", "title", "subtitle", "course_id", "score", F.when(F.col("body") != "", snippet(F.col("body"), query)).alias("snippet"))


def needles(query: str) -> list[str]:
    """The distinct pieces of a query's words, in order; shorter words have none."""
    return list(dict.fromkeys(w[i : i + PIECE] for w in query.lower().split() for i in range(len(w) - PIECE + 1)))


def _postings(words: list[str], places: np.ndarray) -> tuple[list[str], pa.ListArray]:
    """The distinct pieces of some entries' words, and for each the sorted places of those that hold it."""
    points = np.frombuffer((" ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.repeat(places, np.fromiter(map(len, words), np.int64, len(words)) + 1)
    inside = points != ord(" ")
    inside = inside[:-2] & inside[1:-1] & inside[2:]
    pieces, of = np.unique((points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:])[inside], return_inverse=True)
    span = int(places.max()) + 1
    held = np.unique(of * span + at[:-2][inside])
    letters = np.stack([pieces >> np.uint64(42), pieces >> np.uint64(21), pieces], axis=1) & np.uint64((1 << 21) - 1)
    names = letters.astype("<u4").tobytes().decode("utf-32-le")
    ends = np.concatenate([[0], np.cumsum(np.bincount(held // span, minlength=len(pieces)))])
    return [names[i : i + PIECE] for i in range(0, len(names), PIECE)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(held % span, pa.int32()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """piece, block and places of entries' words, for entries of one block that come together and have about CUT characters."""
    for batch in batches:
        words = [w or "" for w in batch.column("words").to_pylist()]
        block, place = (np.asarray(batch.column(c)) for c in ("block", "place"))
        upto = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // CUT
        starts = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(upto, prepend=-1) != 0)) if len(words) else []
        for begin, end in zip(starts, [*starts[1:], len(words)]):
            pieces, places = _postings(words[begin:end], place[begin:end])
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(np.full(len(pieces), block[begin], np.int64)), places], ["piece", "block", "places"])


def build(entries: DataFrame, folder: str, block: int = BLOCK) -> None:
    """Writes the index of entries (as `entity` gives them) into a folder: tables `entries` and `postings`.

    Entries keep the order in which they come and are numbered within their partition, so that their texts aren't shuffled. A posting is a
    piece, a block and the sorted places of the entries in it that hold the piece: no key has more than a block's entries, however frequent
    the piece. Pieces are those within words, and distinct words are cut once. Entries of a block that stand in one batch give one list of a
    piece, so lists are shuffled and not single places, and a frequent piece is spread by its blocks. Each file of postings is sorted. Nulls:
    an entry without text has no pieces; repeated rows are entries of their own."""
    spark = entries.sparkSession
    number = F.monotonically_increasing_id()
    placed = entries.select(*COLUMNS).withColumn("number", number).withColumns({"block": F.floor(F.col("number") / block), "place": (F.col("number") % block).cast("int")}).drop("number")
    placed.write.mode("overwrite").parquet(f"{folder}/entries")
    words = F.array_join(F.array_distinct(F.split("hay", " ")), " ")
    parts = spark.read.parquet(f"{folder}/entries").select("block", "place", words.alias("words")).mapInArrow(_cut, "piece string, block long, places array<int>")
    lists = parts.groupBy("piece", "block").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    lists.sortWithinPartitions("piece", "block").write.mode("overwrite").option("parquet.writer.version", "v2").parquet(f"{folder}/postings")


def candidates(spark: SparkSession, folder: str, query: str) -> DataFrame | None:
    """block and place of the entries that hold all pieces of a query, or None if it has no pieces.

    Within a block the lists meet from the shortest on; a block in which a piece is missing is left out before."""
    wanted = needles(query)
    if not wanted:
        return None
    lists = spark.read.parquet(f"{folder}/postings").filter(F.col("piece").isin(wanted))
    by_block = lists.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(F.size("places").alias("n"), "places"))).alias("lists")).filter(F.size("lists") == len(wanted))
    first = F.col("lists")[0]["places"]
    every = F.aggregate(F.slice("lists", 2, len(wanted)), first, lambda have, more: F.array_intersect(have, more["places"]))
    return by_block.select("block", F.explode(every).alias("place"))


def _held(query: str) -> Column:
    """Whether a text holds all pieces of a query."""
    every = F.lit(True)
    for piece in needles(query):
        every = every & F.col("hay").contains(piece)
    return every


def _few(spark: SparkSession, folder: str, query: str) -> DataFrame | None:
    """The entries that hold all pieces of a query, where they are few enough to be named; else None.

    At most NAMED blocks are named in the filter of the scan, which then leaves out the rest, and at most SENT places are sent to it."""
    at = candidates(spark, folder, query)
    if at is None:
        return None
    blocks = at.groupBy("block").count().limit(NAMED + 1).collect()
    if len(blocks) > NAMED or sum(r["count"] for r in blocks) > SENT:
        return None
    entries = spark.read.parquet(f"{folder}/entries").filter(F.col("block").isin([r["block"] for r in blocks]))
    return entries.join(F.broadcast(at), ["block", "place"], "left_semi")


def fetched(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """The entries that may hold a query: those with all its pieces, or all where it has none.

    Few are found by their places. Many stand in nearly every block, so that their texts are looked through as they are read, which gives the same
    entries; in neither case are entries shuffled."""
    few = _few(spark, folder, query)
    return spark.read.parquet(f"{folder}/entries").filter(_held(query)) if few is None else few


def found(spark: SparkSession, folder: str, query: str, limit: int = 40, course_id: str | None = None) -> DataFrame:
    """The hits of `scanned`, from a written index."""
    return scanned(fetched(spark, folder, query), query, limit, course_id)


def reach(spark: SparkSession, folder: str, queries: Sequence[str]) -> DataFrame:
    """query, entries, read and hits: how many entries there are, how many hold all pieces of a query (all, if it has none), and how many hold it.

    Queries of many entries are counted in one scan, which passes over the others' texts too."""
    every = spark.read.parquet(f"{folder}/entries")
    entries = every.count()
    counted = lambda q, held: F.struct(F.lit(q).alias("query"), F.lit(entries).cast("long").alias("entries"), F.count_if(held).alias("read"), F.count_if(search_score(q, F.col("hay")) > 0).alias("hits"))
    of = [(q, _few(spark, folder, q)) for q in queries]
    broad = [counted(q, _held(q)) for q, few in of if few is None]
    rows = [few.agg(counted(q, F.lit(True)).alias("of")).select("of.*") for q, few in of if few is not None]
    if broad:
        rows.append(every.agg(F.array(*broad).alias("of")).select(F.inline("of")))
    return reduce(DataFrame.unionByName, rows)
