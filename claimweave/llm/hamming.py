"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import bitmap, components, documents, grouped, in_bitmap, map_texts, ship, written

CHUNKS, WIDTH, ERRORS = 7, 4, 1  # 28 indexed symbols in 7 chunks, one wrong symbol allowed in each
SYMBOLS, TOLERANCE = 64, 27  # of the whole signature, and how many may differ
SYMBOL = 2  # bytes
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pair_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's two-word shingles, A-Z in lower case; a single word is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)
    if len(words) == 1:
        return _mix(hashes)
    return np.unique(_mix(hashes[:-1] * _FACTORS[0] + hashes[1:] * _FACTORS[1] + np.uint64(1)))


def _signed(data: bytes, of: int) -> int:
    return int.from_bytes(data[8 * of:8 * of + 8], "little", signed=True)


def signatures(docs: DataFrame, symbols: int) -> DataFrame:
    """Adds to ``row, doc_id`` and the text hashes ``t1, t2`` the set size ``n``, 128 bits of hash
    ``h1, h2`` of the set and ``sig``: the low 16 bits of ``symbols`` minima, each of another
    hash of the shingles."""
    def make():
        seeds = _mix(np.arange(1, symbols + 1, dtype=np.uint64) * _FACTORS[0])

        def fn(columns):
            sets = [pair_set(t) for t in columns["text"]]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            sig = np.zeros((len(sets), symbols), "<u2")
            if len(full):
                joined, begins = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for k, seed in enumerate(seeds):
                    sig[full, k] = np.minimum.reduceat(_mix(joined ^ seed), begins) & np.uint64(0xFFFF)
            digest = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
            return {c: columns[c] for c in ("row", "doc_id", "t1", "t2")} | {
                "n": sizes.tolist(), "sig": [s.tobytes() for s in sig], "h1": [_signed(d, 0) for d in digest], "h2": [_signed(d, 1) for d in digest],
            }
        return fn

    return map_texts(docs, make, "row long, doc_id long, t1 long, t2 long, n long, h1 long, h2 long, sig binary", batch_bytes=1 << 20)


def index_keys(sig: Column, chunks: int, width: int, errors: int) -> Column:
    """All keys of a signature: for each chunk and each choice of ``errors`` symbols in it, a
    hash of the symbols that are left. Two chunks with up to ``errors`` different symbols
    share the key that leaves those out."""
    keys = []
    for chunk in range(chunks):
        for choice, left_out in enumerate(combinations(range(width), errors)):
            kept = [F.substring(sig, SYMBOL * (chunk * width + i) + 1, SYMBOL) for i in range(width) if i not in left_out]
            keys.append(F.xxhash64(F.lit(chunk), F.lit(choice), F.concat(*kept)))
    return F.array(*keys)


def _close(pairs: DataFrame, reps: DataFrame, tolerance: int, percent: int) -> DataFrame:
    """The ``pairs`` of ``rep`` and ``pivot`` whose sizes and signatures let them be similar, with ``d``, the symbols that differ."""
    side = lambda k: reps.select(F.col("rep").alias(k), F.col("sig").alias(f"sig_{k}"), F.col("n").alias(f"n_{k}"))
    both = pairs.join(side("rep"), "rep").join(side("pivot"), "pivot").where(F.least("n_rep", "n_pivot") * 100 >= F.greatest("n_rep", "n_pivot") * percent)
    names = pairs.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sig_rep", "sig_pivot"))
                d = (one != two).sum(axis=1)
                some = d <= tolerance
                yield pa.RecordBatch.from_arrays([*(pa.array(batch.column(c).to_numpy()[some]) for c in names), pa.array(d[some])], names=[*names, "d"])

    ship(pairs.sparkSession)
    return both.select(*names, "sig_rep", "sig_pivot").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "d"]))


def _texts(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rep, text`` of the sets in ``wanted`` (``rep, t1, t2``).

    A bitmap of fixed size keeps most other texts out of the exchange; the join decides.
    """
    marked = base.sparkSession.sparkContext.broadcast(bitmap(wanted, "t1"))

    def make():
        bits, sent = np.frombuffer(marked.value, np.uint8), set()

        def fn(columns):
            hit = in_bitmap(bits, np.array(columns["t1"], np.int64))
            new = []
            for i in np.flatnonzero(hit).tolist():
                key = columns["t1"][i], columns["t2"][i]
                if key not in sent:  # copies go once a task
                    sent.add(key)
                    new.append(i)
            return {c: [columns[c][i] for i in new] for c in ("t1", "t2", "text")}
        return fn

    found = map_texts(base.select("t1", "t2", "text"), make, "t1 long, t2 long, text string")
    return found.groupBy("t1", "t2").agg(F.first("text").alias("text")).join(wanted, ["t1", "t2"]).select("rep", "text")


def _confirmed(pairs: DataFrame, base: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those ``pairs`` of ``rep`` and ``pivot`` (other columns stay) whose full sets reach the similarity."""
    ends = pairs.select("rep").union(pairs.select("pivot")).distinct()
    texts = written(_texts(base, reps.select("rep", "t1", "t2").join(ends, "rep", "left_semi")), "pair-texts")
    both = pairs.join(texts, "rep").join(texts.select(F.col("rep").alias("pivot"), F.col("text").alias("other")), "pivot")
    names = pairs.columns

    def make():
        last: dict[int, np.ndarray] = {}  # the pivot of neighbouring rows is mostly the same

        def fn(columns):
            kept = []
            for i, (pivot, text, other) in enumerate(zip(columns["pivot"], columns["text"], columns["other"])):
                if pivot not in last:
                    last.clear()
                    last[pivot] = pair_set(other)
                mine = pair_set(text)
                common = len(np.intersect1d(mine, last[pivot], assume_unique=True))
                if 100 * common >= percent * (len(mine) + len(last[pivot]) - common):
                    kept.append(i)
            return {c: [columns[c][i] for i in kept] for c in names}
        return fn

    return map_texts(both, make, pairs.schema)


def _relabelled(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """``rep, root``: sets by a set that they hang together with, for those linked so far.

    ``found`` holds links from a set to a pivot ``p`` of label ``to``. Labels say less than
    components do: different ones may belong together, equal ones surely do.
    """
    moved = found.groupBy(F.col("root").alias("was")).agg(F.min(F.struct(F.xxhash64("to").alias("order"), "to")).alias("x")).select("was", "x.to")
    if labels is None:
        return moved.select(F.col("was").alias("rep"), F.col("to").alias("root"))
    rest = labels.join(moved, labels.root == moved.was, "left").select("rep", F.coalesce("to", "root").alias("root"))
    return rest.union(moved.join(labels.select(F.col("rep").alias("was")), "was", "left_anti").select(F.col("was").alias("rep"), F.col("to").alias("root")))


def _tiles(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """Deals each group's ``rows`` (``rep, root`` and more) to units in which all pairs of
    different roots meet once, however large the group: ``unit, side`` and the rows.

    The sets of the root that most rows have are dealt to blocks apart from the others, about
    ``limit`` a block, since they are not compared with each other. A unit is a block of
    others alone, or with a second block of either kind.
    """
    sizes = rows.groupBy(group, "root").agg(F.count("*").alias("m")).groupBy(group).agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("m"))
    blocks = lambda n: F.ceil(n / F.lit(limit)).cast("int")
    sizes = sizes.where("m > most").select(group, "main", blocks(F.col("most")).alias("mains"), blocks(F.col("m") - F.col("most")).alias("others"))
    rows = rows.join(sizes, group)
    is_main = F.col("root") == F.col("main")
    own = F.pmod(F.xxhash64("rep", F.lit(5)), F.when(is_main, F.col("mains")).otherwise(F.col("others")).cast("long")).cast("int")
    # A unit's name: its first block, of others, and its second; the main root's blocks come after all others.
    mine = F.when(is_main, F.col("others") + own).otherwise(own)
    rows = rows.withColumn("mine", mine).withColumn("partner", F.explode(F.when(is_main, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))))
    low, high = F.least("mine", "partner"), F.greatest("mine", "partner")
    side = F.when(low == high, F.lit(0)).when(F.col("mine") == low, F.lit(1)).otherwise(F.lit(2))
    return rows.withColumn("unit", F.xxhash64(group, low, high)).withColumn("side", side).drop("main", "mains", "others", "mine", "partner")


def _asked(table: pa.Table, percent: int) -> np.ndarray:
    """Pairs of a unit that are its own to compare: of different roots, similar sizes and, with two blocks, one of each."""
    side, root, n = (table.column(c).to_numpy() for c in ("side", "root", "n"))
    asked = (root[:, None] != root[None, :]) & (np.minimum.outer(n, n) * 100 >= np.maximum.outer(n, n) * percent)
    return asked & (side[:, None] != side[None, :]) if side.any() else asked


def _forest(linked: np.ndarray, rep: np.ndarray) -> pa.RecordBatch | None:
    """Links ``a, b`` that hold together what a symmetric matrix of links does: one a set at most."""
    least = np.argsort(np.argsort(rep))
    while True:
        lower = np.minimum(least, np.where(linked, least[None, :], len(rep)).min(axis=1))
        if (lower == least).all():
            break
        least = lower
    some = linked.any(axis=1)
    if not some.any():
        return None
    return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(np.sort(rep)[least[some]])], names=["a", "b"])


def _near(tolerance: int, percent: int):
    """A forest of the pairs of a unit whose signatures are close; a set without one is left out."""
    def fn(table):
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(table.num_rows, -1)
        differ = np.zeros((len(sig), len(sig)), np.int16)
        for k in range(sig.shape[1]):
            differ += sig[:, k][:, None] != sig[:, k][None, :]
        return _forest(_asked(table, percent) & (differ <= tolerance), table.column("rep").to_numpy())
    return fn


def _similar(percent: int, cells: int = 4 << 20):
    """A forest of the pairs of a unit whose full sets reach the similarity."""
    def fn(table):
        sets = [pair_set(t) for t in table.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
        order = np.argsort(shingle, kind="stable")
        owner, shingle = owner[order], shingle[order]
        common, width = np.zeros((len(sets), len(sets)), np.float32), max(1, cells // len(sets))
        for start in range(0, int(shingle[-1]) + 1, width):
            lo, hi = np.searchsorted(shingle, [start, start + width])
            part = np.zeros((len(sets), width), np.float32)
            part[owner[lo:hi], shingle[lo:hi] - start] = 1
            common += part @ part.T
        common = np.rint(common).astype(np.int64)
        similar = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        return _forest(_asked(table, percent) & similar, table.column("rep").to_numpy())
    return fn


def near_duplicates(docs: DataFrame, percent: int = 80, chunks: int = CHUNKS, width: int = WIDTH, errors: int = ERRORS, symbols: int = SYMBOLS, tolerance: int = TOLERANCE,
                    rounds: int = 2, tries: int = 3, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: ``doc_id, n_shingles, component_id, kept``.

    Rows are linked if the distinct two-word shingles (A-Z in lower case; a text of one
    word is one shingle) have a Jaccard similarity of ``percent`` or more. Components are
    those of rows: ``component_id`` is the smallest id that links lead to, the row's own
    included, ``kept`` says whether it is the row's own. Texts without a word have no
    links. A row with a null id is compared like any other; its component is null, and it
    is kept, only where no row of it has an id. Rows that repeat an id are rows of their own.

    A signature has ``symbols`` symbols of 16 bits; the first ``chunks * width`` are indexed.
    Pairs that differ in at most ``chunks * (errors + 1) - 1`` of those have, by pigeonhole,
    a chunk with at most ``errors`` different ones; every choice of so many symbols of a
    chunk is left out in turn, so such a pair surely shares a key. A pair at 0.8 differs in
    more than 13 of 28 with probability 0.0004, and even then shares a key unless all chunks
    have two errors or more: 0.00001 in all. Pairs that share a key and differ in up to
    ``tolerance`` of all symbols (more at 0.8: 0.00002) are compared on the full sets.

    Equal sets are combined first. In each bucket of equal keys every set meets a pivot:
    first the least of the bucket in an order that all buckets share, then one of the
    bucket's largest component, another in each bucket. A set is compared with its ``tries``
    closest pivots a round: linear, whatever the bucket's size. Buckets that still hold different
    components are then compared in full, block against block: signatures tell which sets
    may be linked to another component and which belong to one family, and a family's sets
    are compared exactly, its largest component with all others only.
    """
    base = documents(docs, id_col, text_col).select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    rows = written(signatures(base.withColumn("row", F.monotonically_increasing_id()), symbols), "signatures")
    reps = rows.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct(F.col("row").alias("rep"), "t1", "t2", "n", "sig")).alias("x"))
    reps = written(reps.select("h1", "h2", "x.*"), "sets")

    keyed = reps.select("rep", F.explode(index_keys(F.col("sig"), chunks, width, errors)).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    buckets = written(keyed.join(counts, "key"), "buckets")

    links = labels = None
    for turn in range(rounds):
        if turn:
            held = buckets.join(labels, "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
            own = F.struct(F.xxhash64("rep", "key", F.lit(turn)).alias("order"), F.col("rep").alias("pivot"))
            best = held.groupBy("key", "root").agg(F.struct(F.count("*").alias("m"), F.col("root").alias("to"), F.min(own).alias("x")).alias("y"))
            best = best.groupBy("key").agg(F.max("y").alias("y"), F.count("*").alias("labels")).where("labels > 1").select("key", "y.to", "y.x.pivot")
            met = held.join(best, "key").where("root <> to").select("rep", "root", "pivot", "to")
        else:
            own = F.struct(F.xxhash64("rep").alias("order"), F.col("rep").alias("pivot"))
            met = buckets.join(buckets.groupBy("key").agg(F.min(own).alias("x")).select("key", "x.pivot"), "key").where("rep <> pivot")
            met = met.select("rep", F.col("rep").alias("root"), "pivot", F.col("pivot").alias("to"))
        pairs = _close(met.distinct(), reps, tolerance, percent)
        nearest = Window.partitionBy("rep").orderBy("d", F.xxhash64("pivot"), "pivot")  # a set has one pivot a key at most
        pairs = written(pairs.withColumn("i", F.row_number().over(nearest)).where(F.col("i") <= tries).drop("i", "d"), "pairs")
        found = written(_confirmed(pairs, base, reps, percent), "links")
        labels = written(_relabelled(labels, found), "labels")
        found = found.select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
        links = found.union(links) if turn else found

    # What pivots left open: who may be linked to whom, told by signatures.
    held = buckets.join(labels, "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    units = _tiles(held.join(reps.select("rep", "n", "sig"), "rep"), "key", limit)
    near = written(grouped(units, "unit", _near(tolerance, percent), "a long, b long").distinct(), "near")
    if not near.isEmpty():
        # The sets themselves are compared, so families are those of sets and their labels.
        ends = near.select(F.col("a").alias("rep")).union(near.select(F.col("b").alias("rep"))).distinct()
        asked = written(ends.join(labels, "rep", "left").select("rep", F.coalesce("root", "rep").alias("root")), "asked")
        families = components(near.union(asked.select(F.col("rep").alias("a"), F.col("root").alias("b"))))
        asked = asked.join(families.select(F.col("node").alias("rep"), F.col("root").alias("family")), "rep")
        asked = asked.join(reps.select("rep", "n", "t1", "t2"), "rep")
        asked = asked.join(_texts(base, asked.select("rep", "t1", "t2")), "rep")
        links = links.union(grouped(_tiles(asked, "family", limit), "unit", _similar(percent), "a long, b long"))

    roots = components(links).select(F.col("node").alias("rep"), "root")
    owner = reps.select("h1", "h2", "rep").join(roots, "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("root"))
    owned = rows.select("row", "doc_id", "n", "h1", "h2").join(owner, ["h1", "h2"], "left").select("doc_id", "n", F.coalesce("root", "row").alias("root"))
    owned = written(owned, "owned")
    named = owned.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return owned.join(named, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
