"""Token ids in wavelet-matrix shards: one compressed, searchable file each."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.llm.common import WORD, crc_of, documents, shared_dir, ship

MAGIC = b"WVMX0001"
BLOCK = 4096  # bytes of a bit-plane block
_HEAD = struct.Struct("<8sQQII")  # magic, tokens, documents, planes, blocks a plane
_SHARD_SCHEMA = "shard long, part int, first_doc long, n_docs long, n_tokens long, payload binary"


# Fixed values of the tokenizer: its word pattern, for texts of printable ASCII and
# Latin-1 letters; such texts are normal, and lower case changes them letter by letter.
_LATIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
_STEPS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _known_kind(settings: dict) -> bool:
    """Whether a tokenizer file normalises and splits as the fixed values above say."""
    steps = (settings.get("normalizer") or {}).get("normalizers") or []
    splits = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or []
    specials = {t["content"] for t in settings.get("added_tokens") or []}
    return (
        [s["type"] for s in steps] == _STEPS and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": _SPLIT} and not splits[1]["add_prefix_space"]
        and specials <= {"<|startoftext|>", "<|endoftext|>"} and settings["model"].get("end_of_word_suffix") is not None
    )


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The given kind of tokenizer encodes the parts of its word pattern one by one, so
    each different part is encoded once and remembered. Latin texts are cut by that
    pattern; others, and those that hold a special token, only at white space, which
    always parts tokens.
    """

    def __init__(self, tokenizer_json: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_str(tokenizer_json), limit
        self.known, self.older = {}, {}  # two generations, each of up to ``limit`` parts
        settings = json.loads(tokenizer_json)
        self.by_parts, suffix = _known_kind(settings), settings["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.by_parts:
            made = self.tokenizer.encode_batch_fast([text or "" for text in texts], add_special_tokens=False)
            return [np.array(x.ids, "<u4") for x in made]
        split = []
        for text in texts:
            text = text or ""
            latin = _LATIN.fullmatch(text) and not _SPECIAL.search(text)
            parts = _PARTS.findall(text.lower()) if latin else re.findall(WORD, text)
            split.append(parts)
            self._learn(set(parts).difference(self.known), bool(latin))
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4") for parts in split]
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        return out

    def _learn(self, words: set[str], single: bool) -> None:
        for word in [w for w in words if w in self.older]:
            self.known[word] = self.older[word]
            words.discard(word)
        words = list(words)
        if single and words:
            # Each is one part, so its last token, and no other, ends a word.
            ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(words) and stops[-1] == len(ids):
                data, start = ids.tobytes(), 0
                for word, stop in zip(words, (4 * stops).tolist()):
                    self.known[word] = data[start:stop]
                    start = stop
                return
        for start in range(0, len(words), 4096):
            part = words[start:start + 4096]
            for word, made in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[word] = np.array(made.ids, "<u4").tobytes()


_ENCODERS: dict[int, Encoder] = {}


def _encoder(tokenizer_json: str) -> Encoder:
    """One encoder a Python worker: what it has learnt serves its later tasks."""
    key = crc_of(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_json)
    return _ENCODERS[key]


def _squeeze(data: bytes, coder: zstandard.ZstdCompressor) -> bytes:
    """A flag byte, then the data, compressed if that is shorter."""
    small = coder.compress(data)
    return b"\1" + small if len(small) < len(data) else b"\0" + data


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[1:]) if data[:1] == b"\1" else bytes(data[1:])


def pack(doc_ids: list[int | None], counts: list[int], tokens: np.ndarray) -> bytes:
    """A shard file: header, document table, rank directory, block table, blocks.

    Planes go from the highest bit down; each holds one bit a token in the order left
    by a stable partition on the bits before. Blocks of ``BLOCK`` bytes are compressed
    one by one, and the ones before each block are counted, so one lookup expands one
    block a plane.
    """
    n = len(tokens)
    planes = max(1, int(tokens.max(initial=0)).bit_length())
    coder = zstandard.ZstdCompressor(level=1, write_checksum=False)
    per_plane = -(-n // (8 * BLOCK))
    ranks, zeros, blocks = np.zeros((planes, per_plane + 1), "<u4"), np.zeros(planes, "<u8"), []
    current = np.asarray(tokens).astype(np.uint16 if planes <= 16 else np.uint32)
    for p in range(planes):
        one = (current & current.dtype.type(1 << (planes - 1 - p))) != 0
        bits = np.packbits(one, bitorder="little")
        if n:
            ranks[p, 1:] = np.cumsum(np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), BLOCK), dtype=np.uint32))
        zeros[p] = n - int(ranks[p, -1])
        packed = bits.tobytes()
        blocks += [_squeeze(packed[b:b + BLOCK], coder) for b in range(0, len(packed), BLOCK)]
        current = np.concatenate([current[~one], current[one]])
    null = np.array([d is None for d in doc_ids], bool)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    table = _squeeze(np.packbits(null).tobytes() + np.diff(ids, prepend=0).astype("<i8").tobytes() + np.array(counts, "<u8").tobytes(), coder)
    directory = _squeeze(zeros.tobytes() + ranks.tobytes() + np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes(), coder)
    head = _HEAD.pack(MAGIC, n, len(ids), planes, per_plane)
    return b"".join([head, struct.pack("<QQ", len(table), len(directory)), table, directory, *blocks])


class Shard:
    """Reads a packed shard: documents, tokens by position, counts and occurrences."""

    def __init__(self, data: bytes):
        magic, self.n, self.n_docs, self.planes, self.per_plane = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = _HEAD.size + 16
        table, directory = struct.unpack_from("<QQ", data, _HEAD.size)
        docs = _expand(data[at:at + table])
        flags = -(-self.n_docs // 8)
        null = np.unpackbits(np.frombuffer(docs[:flags], np.uint8))[:self.n_docs].astype(bool)
        ids = np.cumsum(np.frombuffer(docs[flags:flags + 8 * self.n_docs], "<i8"))
        self.doc_ids = [None if x else int(i) for x, i in zip(null, ids)]
        self.ends = np.cumsum(np.frombuffer(docs[flags + 8 * self.n_docs:], "<u8").astype(np.int64))
        rest = _expand(data[at + table:at + table + directory])
        self.zeros = np.frombuffer(rest[:8 * self.planes], "<u8").astype(np.int64)
        size = 4 * self.planes * (self.per_plane + 1)
        self.ranks = np.frombuffer(rest[8 * self.planes:8 * self.planes + size], "<u4").reshape(self.planes, -1).astype(np.int64)
        self.offsets = np.frombuffer(rest[8 * self.planes + size:], "<u8").astype(np.int64)
        self.data, self.base, self.open = data, at + table + directory, {}

    def _block(self, plane: int, block: int) -> np.ndarray:
        """The bits of a block as 0 and 1."""
        key = plane * self.per_plane + block
        if key not in self.open:
            if len(self.open) > 4 * self.planes:
                self.open.clear()
            packed = _expand(self.data[self.base + self.offsets[key]:self.base + self.offsets[key + 1]])
            self.open[key] = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")
        return self.open[key]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, rest = divmod(int(i), 8 * BLOCK)
        return int(self.ranks[plane, block]) + (int(self._block(plane, block)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        """The token at a position of the shard."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            bit = int(self._block(p, i // (8 * BLOCK))[i % (8 * BLOCK)])
            ones = self._ones(p, i)
            i = int(self.zeros[p]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for p in range(self.planes):
            lo, hi = self._ones(p, start), self._ones(p, end)
            if token >> (self.planes - 1 - p) & 1:
                start, end = int(self.zeros[p]) + lo, int(self.zeros[p]) + hi
            else:
                start, end = start - lo, end - hi
        return start, end

    def rank(self, token: int, i: int | None = None) -> int:
        """Occurrences of a token before position ``i`` (all: the count)."""
        if token < 0 or token >> self.planes:
            return 0
        start, end = self._range(token, 0, self.n if i is None else i)
        return end - start

    def select(self, token: int, k: int) -> int:
        """The position of the ``k``-th occurrence, from 0; -1 if there are fewer."""
        if k < 0 or k >= self.rank(token):
            return -1
        i = self._range(token, 0, self.n)[0] + k
        for p in reversed(range(self.planes)):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._select(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def _select(self, plane: int, bit: int, k: int) -> int:
        before = self.ranks[plane] if bit else np.minimum(np.arange(self.per_plane + 1) * 8 * BLOCK, self.n) - self.ranks[plane]
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = self._block(plane, block)[:min(8 * BLOCK, self.n - block * 8 * BLOCK)]
        return block * 8 * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def tokens(self) -> np.ndarray:
        """All tokens: the partitions are undone from the lowest plane up."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        value = np.zeros(self.n, kind)
        for p in reversed(range(self.planes)):
            one = np.concatenate([self._block(p, b) for b in range(self.per_plane)] or [np.zeros(0, np.uint8)])[:self.n].astype(bool)
            self.open.clear()
            above, zeros = np.empty(self.n, kind), int(self.zeros[p])
            above[~one] = value[:zeros]
            above[one] = value[zeros:] | kind(1 << (self.planes - 1 - p))
            value = above
        return value.astype(np.uint32)


def write_shards(docs: DataFrame, tokenizer_json: str, end_id: int = 1, shard_tokens: int = 1 << 20, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes whole texts as wavelet shards in ascending id order; returns the folder.

    Texts are dealt into ranges of ids, sorted, encoded and cut into shards of about
    ``shard_tokens`` tokens inside each task; a text longer than that has a shard of
    its own. A shard is one binary value (``pack``) in a row of the folder's Parquet
    files, so Spark's commit protocol covers lost executors and retried tasks, and any
    store Spark reads will do. Null ids come first, null texts are empty, and equal
    ids are ordered by a hash of their text.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(tokenizer_json)
    rows = documents(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), _encoder(sent.value)
        made, ids, counts, held, size = 0, [], [], [], 0

        def shard():
            return pa.RecordBatch.from_pydict({
                "shard": [part << 32 | made], "part": [part], "first_doc": [ids[0]], "n_docs": [len(ids)], "n_tokens": [size],
                "payload": [pack(ids, counts, np.concatenate(held))],
            }, schema=schema)

        schema = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
        end = np.array([end_id], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc_id, tokens in zip(some.column(0).to_pylist(), encoder(some.column(1).to_pylist())):
                    ids.append(doc_id)
                    counts.append(len(tokens) + 1)
                    held += [tokens, end]
                    size += len(tokens) + 1
                    if size >= shard_tokens:
                        yield shard()
                        made, ids, counts, held, size = made + 1, [], [], [], 0
        if ids:
            yield shard()

    path = path or f"{shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    dealt.mapInArrow(run, _SHARD_SCHEMA).write.option("compression", "none").parquet(path)
    return path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Reads the shards back: ``doc_id, start, n_tokens, ids_crc32, shard, position``.

    ``start`` counts the tokens of all documents before, ``position`` those before in
    the shard. Two running sums find it: over the shards of a part, and over the parts.
    """
    ship(spark)
    shards = spark.read.schema(_SHARD_SCHEMA).parquet(path)
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("part_start"))
    starts = (
        shards.select("shard", "part", "n_tokens").withColumn("in_part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(parts, "part").select("shard", (F.col("in_part") + F.col("part_start")).alias("shard_start"))
    )

    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_py())
                tokens = shard.tokens().astype("<u4")
                begins = np.concatenate([[0], shard.ends[:-1]])
                yield pa.RecordBatch.from_pydict({
                    "shard": np.full(shard.n_docs, number), "doc_id": pa.array(shard.doc_ids, pa.int64()), "position": begins,
                    "n_tokens": shard.ends - begins,
                    "ids_crc32": pa.array([crc_of(tokens[a:b].tobytes()) for a, b in zip(begins, shard.ends)], pa.int64()),
                })

    rows = shards.select("shard", "payload").mapInArrow(run, "shard long, doc_id long, position long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("position")).alias("start"), "n_tokens", "ids_crc32", "shard", "position")


def lookup(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``shard, n, first_position, first_doc``: how often and where first a token occurs in each shard that has it."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_py())
                n = shard.rank(token)
                if n:
                    first = shard.select(token, 0)
                    doc = shard.doc_ids[int(np.searchsorted(shard.ends, first, "right"))]
                    yield pa.RecordBatch.from_pydict({"shard": [number], "n": [n], "first_position": [first], "first_doc": pa.array([doc], pa.int64())})

    return spark.read.schema(_SHARD_SCHEMA).parquet(path).select("shard", "payload").mapInArrow(run, "shard long, n long, first_position long, first_doc long")
