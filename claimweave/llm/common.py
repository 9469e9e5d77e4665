"""Helpers shared by the operators: written tables, text batches, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words, as the contracts split them: only these characters separate.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Unset, as in tests: a fresh folder of this machine, and only with a local master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once an application.

    They then need no installation and no PYTHONPATH. Only source files go, over
    Spark's own file server.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; ids that are null count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def crc_of(values: bytes) -> int:
    return zlib.crc32(values) & 0xFFFFFFFF


def map_texts(df: DataFrame, make: Callable[[], Callable], schema: T.StructType | str, batch_bytes: int = 4 << 20) -> DataFrame:
    """Whole texts through ``make()``'s function, a few megabytes at a time.

    ``df`` has the texts in ``text`` and any other columns. ``make`` runs once a
    task and returns ``fn(columns: dict[str, list]) -> dict[str, list]``.
    """
    spark = df.sparkSession
    ship(spark)
    struct = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in struct.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column("text")).to_pylist()
            start, held = 0, 0
            for end, size in enumerate(sizes, 1):
                held += size or 0
                if held >= batch_bytes or end == len(sizes):
                    part = batch.slice(start, end - start)
                    out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
                    start, held = end, 0

    import pyarrow.compute  # noqa: F401  (loaded for the closure)
    return df.mapInArrow(run, struct)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    return row[0], row[1]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find over links ``(a, b)`` of longs: ``(node, root)``.

    ``root`` is the smallest id of the component; ids without a link to another id
    are left out. Alternates large stars and small stars: each round is a minimum
    by node, combined before the shuffle, and a join back that adaptive execution
    can split at hubs. Every round is checkpointed to the shared folder; only a
    count and a checksum of the edges reach the driver. Nulls and self-links are
    ignored.
    """
    shared_dir(edges.sparkSession)
    e = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    )
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        # Large star: every larger neighbour of a node goes to the node's minimum.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every smaller neighbour, and the node itself, to the minimum.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = small.union(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        last, mark = mark, _mark(e)
        if last == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # A settled graph has one star a component.
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def grouped(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` on each group of equal ``key`` (a long), rows sorted by it, many small groups a batch.

    For groups whose size the caller bounds. ``fn`` returns columns of ``schema`` or None.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table):
            keys = table.column(key).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for start, end in zip([0, *cuts], [*cuts, len(keys)]):
                out = fn(table.slice(start, end - start))
                if out is not None and out.num_rows:
                    yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if held and held[0].column(key)[0].as_py() != keys[0]:
                yield from groups(pa.Table.from_batches(held))
                held = []
            if last:
                yield from groups(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from groups(pa.Table.from_batches(held))

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


#: Slots of a bitmap: 4 MB, whatever is put in. A fuller one lets more through, never less.
BITMAP_BITS = 25
_BUCKET = 32768  # bits of one value of bitmap_construct_agg


def bitmap(df: DataFrame, column: str) -> bytes:
    """A bitmap of the high bits of the 64-bit hashes in ``column``; it reaches the driver, 4 MB at most."""
    slot = F.shiftrightunsigned(column, 64 - BITMAP_BITS) + 1  # these functions count from 1
    rows = df.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = bytearray(1 << (BITMAP_BITS - 3))
    for row in rows.toLocalIterator():
        start = (row.bucket - 1) * (_BUCKET // 8)
        out[start:start + _BUCKET // 8] = row.bits
    return bytes(out)


def in_bitmap(bits, hashes):
    """Which hashes (a numpy array of 64-bit integers) may be in a bitmap given as bytes in an array."""
    import numpy as np

    slot = hashes.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
