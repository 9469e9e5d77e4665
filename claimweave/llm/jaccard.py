"""Chosen-path similarity join: documents whose word shingles overlap, at a target recall."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import components, documents, grouped, map_texts, written

WORDS, THRESHOLD = 5, 0.8
_FACTORS = np.array([pow(0xD6E8FEB86659FD93, 2 * k + 1, 1 << 64) for k in range(64)], np.uint64)
_SIGNED = np.dtype("<i8")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; a shorter text is one run."""
    parts = (text or "").encode("utf-8", "surrogatepass").split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.array(list(map(xxhash.xxh64_intdigest, parts)), np.uint64)
    width = min(words, len(parts))
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        total += hashes[k:k + len(total)] * _FACTORS[k]
    return np.unique(_mix(total + np.uint64(width)))


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs that find a pair at the threshold with probability ``recall``, were it split at every level."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def _signatures(docs: DataFrame, words: int, runs: int, depth: int) -> DataFrame:
    """Per row: ``doc_id, h1, h2`` (a 128-bit hash of the text), ``size`` of the shingle set, the
    bucket ``paths`` of all runs and levels, and a ``sketch`` with a byte of each sampled token."""
    def make():
        seeds = _mix(np.arange(1, runs * depth + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

        def fn(columns):
            sets = [shingles(t, words) for t in columns["text"]]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            sampled = np.zeros((len(sets), runs * depth), np.uint64)
            if len(full):
                joined, begins = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for k, seed in enumerate(seeds):
                    # The token with the least hash: two sets draw the same one with probability J.
                    sampled[full, k] = np.minimum.reduceat(_mix(joined ^ seed), begins)
            path = np.zeros_like(sampled)
            for r in range(runs):
                above = np.full(len(sets), r + 1, np.uint64)
                for d in range(depth):
                    above = path[:, r * depth + d] = _mix(above * np.uint64(0x9E3779B97F4A7C15) + sampled[:, r * depth + d])
            digest = [xxhash.xxh128_digest((t or "").encode("utf-8", "surrogatepass")) for t in columns["text"]]
            sketch = (sampled & np.uint64(255)).astype(np.uint8)
            return {
                "doc_id": columns["doc_id"], "size": sizes.tolist(), "paths": list(path.view(np.int64)), "sketch": [s.tobytes() for s in sketch],
                "h1": [int.from_bytes(x[:8], "little", signed=True) for x in digest], "h2": [int.from_bytes(x[8:], "little", signed=True) for x in digest],
            }
        return fn

    return map_texts(docs, make, "doc_id long, h1 long, h2 long, size long, paths array<long>, sketch binary", batch_bytes=1 << 20)


def _buckets(reps: DataFrame, runs: int, depth: int, limit: int) -> DataFrame:
    """``leaf, rep, sketch, members``: each run's buckets of two or more, split on further
    sampled tokens while they hold more than ``limit`` sets and levels are left.

    Only keys move: the paths of the sets still in large buckets are looked up again.
    """
    keys = lambda of, level: F.element_at("paths", F.col(of) * depth + level + 1)
    rows = reps.select(F.col("doc_id").alias("rep"), "paths", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).select("rep", "run", keys("run", 0).alias("leaf"))
    leaves = None
    for level in range(depth):
        counts = rows.groupBy("leaf").agg(F.count("*").alias("members")).where("members > 1")
        held = written(rows.join(counts, "leaf"), "buckets")
        last = level == depth - 1
        done = (held if last else held.where(F.col("members") <= limit)).select("leaf", "rep", "members")
        leaves = done if leaves is None else leaves.union(done)
        if not last:
            large = held.where(F.col("members") > limit).select("rep", "run")
            rows = large.join(reps.select(F.col("doc_id").alias("rep"), "paths"), "rep").select("rep", "run", keys("run", level + 1).alias("leaf"))
    # Buckets of different runs with the same members are one bucket.
    marks = leaves.groupBy("leaf").agg(F.expr("bit_xor(xxhash64(rep))").alias("x"), F.sum(F.xxhash64("rep", F.lit(7)) % 1000000007).alias("y"), F.count("*").alias("n"))
    kept = marks.groupBy("x", "y", "n").agg(F.min("leaf").alias("leaf")).select("leaf")
    return leaves.join(kept, "leaf").join(reps.select(F.col("doc_id").alias("rep"), "sketch"), "rep")


def _units(rows: DataFrame, limit: int) -> DataFrame:
    """Adds ``unit``, ``side``: a bucket of more than ``limit`` sets becomes pairs of blocks of about
    ``limit`` sets, so that no task holds a whole large bucket; smaller ones are one unit."""
    blocks = F.ceil(F.col("members") / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(11)), blocks.cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    return (
        rows.withColumn("pair", F.explode(pairs)).withColumn("own", own)
        .withColumn("unit", F.when(F.col("members") <= limit, F.col("leaf")).otherwise(F.xxhash64("leaf", "pair.i", "pair.j")))
        .withColumn("side", F.when(F.col("pair.i") == F.col("pair.j"), F.lit(0)).when(F.col("own") == F.col("pair.i"), F.lit(1)).otherwise(F.lit(2)))
        .drop("pair", "own")
    )


def _asked(table: pa.Table) -> np.ndarray:
    """Which pairs of a unit are compared: all, or those between its two blocks."""
    side = table.column("side").to_numpy()
    asked = (side[:, None] != side[None, :]) if side.any() else np.ones((len(side), len(side)), bool)
    np.fill_diagonal(asked, False)
    return asked


def _common(sets: list[np.ndarray], cells: int = 8 << 20) -> np.ndarray:
    """Sizes of all intersections, from products of blocks of an incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, cells // len(sets))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[lo:hi], column[lo:hi] - start] = 1
        out += block @ block.T
    return np.rint(out).astype(np.int64)


def _candidates(least: int):
    """Sets of a unit that agree with another in at least ``least`` sampled tokens."""
    def fn(table):
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        asked, equal = _asked(table), np.zeros((len(sketch), len(sketch)), np.int16)
        for k in range(sketch.shape[1]):
            equal += sketch[:, k][:, None] == sketch[:, k][None, :]
        some = (asked & (equal >= least)).any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(table.column(c).to_numpy()[some]) for c in ("leaf", "rep", "members")], names=["leaf", "rep", "members"]) if some.any() else None
    return fn


def _links(threshold: float):
    """Exact similarities inside a unit: ``rep, root, links`` a set that has a link.

    ``links`` weighs each partner by its copies and counts a pair only in the first
    of the buckets that hold both; ``root`` is the smallest set it hangs together
    with in this unit.
    """
    def fn(table):
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        rep, copies, leaf = table.column("rep").to_numpy(), table.column("copies").to_numpy(), table.column("leaf")[0].as_py()
        inter, sizes = _common(sets), np.array([len(s) for s in sets])
        union = sizes[:, None] + sizes[None, :] - inter
        linked = _asked(table) & (inter >= threshold * union - 1e-9)
        if not linked.any():
            return None
        earlier = [np.array([x for x in own if x < leaf], np.int64).view(np.uint64) for own in table.column("leaves").to_pylist()]
        seen = _common(earlier) > 0
        links = (linked & ~seen).astype(np.int64) @ copies
        root = np.argsort(np.argsort(rep))
        while True:
            least = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1))
            if (least == root).all():
                break
            root = least
        some = linked.any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(np.sort(rep)[root[some]]), pa.array(links[some])], names=["rep", "root", "links"])
    return fn


def similar(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = 0.9999, depth: int = 2, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, class_id, n_links, copy_of``.

    Two documents are linked if the Jaccard similarity of their sets of ``words``-word
    runs is at least ``threshold``. ``n_links`` counts a document's links, copies
    included; ``class_id`` is the smallest id that links lead to; ``copy_of`` the
    smallest id with the same text. Texts without a word have no links.

    Copies are joined first and stand for one set. In each run every set goes down a
    path of sampled tokens (minima of a hash, drawn alike by two sets with the
    probability of their similarity): a bucket of up to ``limit`` sets is compared
    in full, a larger one is split on the next token; after ``depth`` levels it is
    compared block by block. Runs repeat until a pair at the threshold is found
    with probability ``recall`` even if split at every level. Pairs are
    compared by a sketch of the sampled tokens first (a pair at the threshold fails
    it with probability about 1e-5), then exactly, inside the bucket; only counts
    and one link a set leave it. Nothing is capped: large buckets are cut into
    more pieces. Rows with a null id cannot be named and get null and 0; rows that
    repeat an id get the same answer (if their texts differ, one of them counts).
    """
    runs = runs_for(recall, threshold, depth)
    drawn = runs * depth
    least = math.floor(threshold * drawn - 4.3 * math.sqrt(drawn * threshold * (1 - threshold)))
    base = documents(docs, id_col, text_col)
    rows = written(_signatures(base, words, runs, depth), "shingle-signatures")
    named = rows.where("doc_id IS NOT NULL AND size > 0")
    copies = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    same = written(named.select("doc_id", "h1", "h2").join(copies, ["h1", "h2"]).groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("copies").alias("copies")), "copies")
    reps = same.where("doc_id = rep").select("rep", "copies")
    tables = written(rows.join(reps.select(F.col("rep").alias("doc_id")), "doc_id").groupBy("doc_id").agg(F.min(F.struct("sketch", "paths")).alias("x")).select("doc_id", "x.*"), "sampled-tokens")
    found = grouped(_units(_buckets(tables, runs, depth, limit), limit), "unit", _candidates(max(1, least)), "leaf long, rep long, members long")
    found = written(found.distinct(), "candidates")
    own = found.groupBy("rep").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))  # at most one bucket a run

    def make():
        def fn(columns):
            return {"rep": columns["doc_id"], "shingles": [shingles(t, words).tobytes() for t in columns["text"]]}
        return fn

    # Always a sort-merge join: the ids grow with the table, so the plan is the same at every size.
    wanted = base.join(own.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    sets = map_texts(wanted, make, "rep long, shingles binary", batch_bytes=1 << 20).groupBy("rep").agg(F.min("shingles").alias("shingles"))
    units = _units(found.join(own, "rep"), limit).join(reps, "rep").join(sets, "rep")
    links = written(grouped(units, "unit", _links(threshold), "rep long, root long, links long"), "links")
    roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), F.col("root").alias("class_id"))
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    per_rep = reps.join(counted, "rep", "left").join(roots, "rep", "left").select(
        "rep", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    answer = same.select("doc_id", "rep").join(per_rep, "rep").select("doc_id", "class_id", "n_links", F.col("rep").alias("copy_of"))
    return base.select("doc_id").join(answer, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copy_of", "doc_id").alias("copy_of"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row of each class of near copies: of those with an id the one of the smallest.

    Every row is compared by a number of its own, so rows that repeat an id are copies
    of each other only if their texts are. Of a class's rows with a null id one stays
    too, since it cannot be named as a copy of the others. Texts without words all stay.
    """
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")  # written, so that numbers stay
    answer = similar(numbered, id_col="_row", **options).select(F.col("doc_id").alias("_row"), "class_id")
    ids = numbered.select("_row", F.col(id_col).cast("long").alias("_id"))
    first = answer.join(ids, "_row").groupBy("class_id", F.isnull("_id")).agg(F.min(F.struct("_id", "_row")).alias("x")).select("x._row")
    return numbered.join(first, "_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
