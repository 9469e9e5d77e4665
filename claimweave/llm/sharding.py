"""Hierarchical weighted hash tree: documents to shards, level by level."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import documents


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree. Its weight counts for its rack and its region too."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(n: int, racks: int = 4, per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """Shards 0..n-1 of equal weight, ``per_rack`` a rack, ``racks_per_region`` a region, at most ``racks`` racks."""
    if n > racks * per_rack:
        raise ValueError("more shards than the racks hold; use grow()")
    return [Shard(f"r{s // (per_rack * racks_per_region)}", f"k{s // per_rack}", s) for s in range(n)]


def grow(shards: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, as a region of its own.

    No other subtree changes its weight, so rows move into the new shard only. A
    shard added to an existing rack would also draw rows from other regions into
    that rack's siblings, because the rack and the region grow with it.
    """
    new = max(s.shard for s in shards) + 1
    return [*shards, Shard(f"r-grown-{new}", f"k-grown-{new}", new, weight)]


def _draw(path: str, key: Column) -> Column:
    """A uniform number in (0, 1) from the node's path and the key: 53 bits of xxhash64."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(path), key), 11).cast("double") + 0.5) * 2.0**-53


def _choose(children: dict, key: Column, child_id) -> Column:
    """The child with the least -ln(u) / weight: chosen in proportion to its weight, and
    a change of one weight moves keys only to or from that child. Ties: the smaller id."""
    if len(children) == 1:
        return F.lit(child_id(next(iter(children))))
    draws = [
        F.struct((-F.log(_draw("/".join(map(str, node)), key)) / F.lit(float(weight))).alias("cost"), F.lit(child_id(node)).alias("id"))
        for node, weight in children.items()
    ]
    return F.array_min(F.array(*draws))["id"]


def _by_parent(parents: dict, column: Column, key: Column, child_id) -> Column:
    out = None
    for parent, children in parents.items():
        choice = _choose(children, key, child_id)
        out = F.when(column == parent, choice) if out is None else out.when(column == parent, choice)
    return out


def place(df: DataFrame, shards: list[Shard], key: str = "doc_id", prefix: str = "") -> DataFrame:
    """Adds ``region``, ``rack`` and ``shard`` (after ``prefix``), by the key alone.

    Native expressions on one row: no shuffle. A null key is a key like any other.
    Rack and shard names count within their parent; weights must be positive.
    """
    if not shards or any(s.weight <= 0 for s in shards):
        raise ValueError("shards with positive weights are needed")
    regions, racks, leaves = defaultdict(float), defaultdict(lambda: defaultdict(float)), defaultdict(lambda: defaultdict(float))
    for s in shards:
        regions[s.region,] += s.weight
        racks[s.region][s.region, s.rack] += s.weight
        leaves[f"{s.region}/{s.rack}"][s.region, s.rack, s.shard] += s.weight
    k = F.col(key)
    region, rack, shard = f"{prefix}region", f"{prefix}rack", f"{prefix}shard"
    return (
        df.withColumn(region, _choose(dict(regions), k, lambda n: n[0]))
        .withColumn(rack, _by_parent(racks, F.col(region), k, lambda n: n[1]))
        .withColumn(shard, _by_parent(leaves, F.concat_ws("/", region, rack), k, lambda n: n[2]).cast("int"))
    )


def shard_documents(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None, parts: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, size, text_crc32, shard, slot, grown_shard, region, rack``.

    ``slot`` counts a shard's documents from 0 without gaps. Each shard's rows are
    dealt into ``parts`` pieces by a hash of the whole row, numbered piece by piece
    (by doc_id, size, text_crc32), and moved up by the counts of the pieces before,
    so no task sorts a whole shard. Null text: size 1, checksum 0. Null ids go to one
    shard; repeated ids go to the same shard and get slots of their own.
    """
    base = documents(docs, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = place(base, shards)
    if grown:
        rows = place(rows, grown, prefix="grown_")
    else:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)).cast("int"))
    from pyspark.sql import Window

    within = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x parts rows, whatever the table's size.
    starts = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (
        rows.withColumn("row", F.row_number().over(within))
        .join(starts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.col("shard"), (F.col("start") + F.col("row") - 1).alias("slot"), "grown_shard", "region", "rack")
    )
