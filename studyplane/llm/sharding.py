"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one slot-numbering bucket, about.
BUCKET_ROWS = 200_000


@dataclass(frozen=True)
class Leaf:
    """One shard below a rack below a region. Its weight is the share of rows it should get."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def regular_tree(regions: int, racks: int, shards: int) -> list[Leaf]:
    """A tree of equal weights, its shards numbered from 0."""
    return [Leaf(g, r, (g * racks + r) * shards + s) for g in range(regions) for r in range(racks) for s in range(shards)]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard on a branch of its own.

    Only that branch's weight changes, from nothing, so rows move into the new shard and nowhere else."""
    return [*tree, Leaf(max(x.region for x in tree) + 1, 0, max(x.shard for x in tree) + 1, weight)]


def _draw(key: Column, level: str, node: str, weight: float) -> Column:
    """-ln(u) / weight, u uniform in (0, 1) by key and node: the least of them wins with a chance in proportion to its weight."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def _descend(key: Column, tree: Sequence[Leaf], path: tuple[int, ...] = ()) -> Column:
    """The shard that key reaches from the node at path: at each level the child with the least draw."""
    depth = len(path)
    if depth == 2 and len(tree) == 1:
        return F.lit(tree[0].shard)
    name = (lambda x: (x.region, x.rack, x.shard)[depth])
    children = {c: [x for x in tree if name(x) == c] for c in sorted({name(x) for x in tree})}
    down = {c: F.lit(c) if depth == 2 else _descend(key, below, (*path, c)) for c, below in children.items()}
    if len(children) == 1:
        return next(iter(down.values()))
    level = ("region", "rack", "shard")[depth]
    draws = [F.struct(_draw(key, level, "/".join(map(str, (*path, c))), sum(x.weight for x in below)).alias("draw"), F.lit(c).alias("child")) for c, below in children.items()]
    won = F.least(*draws)["child"]
    out = None
    for c, shard in down.items():
        out = F.when(won == c, shard) if out is None else out.when(won == c, shard)
    return out


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard of a key in a tree. The key's string form decides, together with the tree; a null key counts as the empty string.

    Leaves of weight 0 or less take nothing; a tree without any other leaf is an error."""
    alive = [x for x in tree if x.weight > 0]
    if not alive:
        raise ValueError("the tree has no shard of a positive weight")
    if len({x.shard for x in alive}) < len(alive):
        raise ValueError("a shard occurs twice in the tree")
    return _descend(F.coalesce(key.cast("string"), F.lit("")), alive).cast("int")


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str, rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """df with `name`: 0, 1, ... inside each group, without bringing a group together.

    Each group is dealt by a hash of `order` into buckets; a bucket's numbers begin after those of the buckets before it.
    Rows alike in all of `order` get numbers in either order."""
    total = df.count()
    buckets = max(1, -(-total // rows_per_bucket)) * 8
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = df.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select(group, "_bucket", (F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)) - 1
    return df.withColumn("_rank", rank).join(before, [group, "_bucket"]).withColumn(name, (F.col("_rank") + F.col("_before")).cast("long")).drop("_bucket", "_rank", "_before")


def sharded(docs: DataFrame, tree: Sequence[Leaf], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shard by the hash tree, its shard in the tree with one more, and its slot in the shard.

    Columns: doc_id, size (UTF-8 bytes plus 1; null text: 1), text_crc32 (null: that of the empty text), law, shard, slot, grown_shard.
    A null id goes where the empty string goes; repeated rows share a shard and get slots of their own; other columns are not read.
    No rows give no rows."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(id_col), tree).alias("shard"),
        shard_of(F.col(id_col), grown(tree)).alias("grown_shard"),
    )
    return numbered(rows, "shard", ["doc_id", "size", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
