"""Removal of repeated byte strings with sparse suffix arrays in a logarithmic family."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import documents, grouped, ship, written

LENGTH = 50  # bytes of a repeated string
HEAD = 16  # bytes that choose the sampled suffixes
_REACH = LENGTH - HEAD  # a string may start so far before its sampled suffix
_SPAN = _REACH + LENGTH
_LAST = np.iinfo(np.int64).max  # stands for a null id: after all others
_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = {m: np.uint64(int(x) | 1) for m, x in zip((1, 2, 4, 8, 16, 32), _RNG.integers(1, 2**63, 6, dtype=np.uint64))}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _doubled(x: np.ndarray, widths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all strings of the given power-of-two widths along the last axis."""
    out, width = {1: x}, 1
    while width < max(widths):
        x = x[..., :x.shape[-1] - width] * _STEP[width] + x[..., width:]
        width *= 2
        if width in widths:
            out[width] = x
    return out


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x, done = pick(x[:-done], x[done:]), 2 * done
    return pick(x[:len(x) - (width - done)], x[width - done:]) if width > done else x


def sampled(data: bytes, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Positions and head hashes of the suffixes to keep: wherever the 16 bytes at a
    position hash to the least value of some 50-byte string around them. Every 50-byte
    string holds one, at the same place wherever the string occurs."""
    at, heads = [], []
    for start in range(0, max(1, len(data) - LENGTH + 1), piece):
        part = np.frombuffer(data[start:start + piece + LENGTH - 1], np.uint8)
        if len(part) < LENGTH:
            continue
        head = _mix(_doubled(_BYTES[part], (HEAD,))[HEAD])
        least = _sliding(head, _REACH + 1, np.minimum)
        # A head is the least of a window if the largest minimum around it equals it.
        padded = np.concatenate([np.zeros(_REACH, np.uint64), least, np.zeros(_REACH, np.uint64)])
        keep = np.flatnonzero(_sliding(padded, _REACH + 1, np.maximum) == head)
        at.append(keep + start)
        heads.append(head[keep])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(at), return_index=True)
    return at, np.concatenate(heads)[first]


class Family:
    """Sorted runs of suffixes, each with its smallest document; runs of a size merge.

    Runs come in ascending order of document. ``scan`` looks a run up in all levels,
    ``add`` makes it a level and merges levels while the last is as large as the one before.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which keys occur in a smaller document."""
        found = np.zeros(len(keys), bool)
        for level, owner in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            found |= (level[at] == keys) & (owner[at] < docs)
        return found

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        if not len(keys):
            return
        self.levels.append((keys, docs))
        while len(self.levels) > 1 and len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            (new, new_docs), (old, old_docs) = self.levels.pop(), self.levels.pop()
            keys, docs = np.concatenate([old, new]), np.concatenate([old_docs, new_docs])
            order = np.argsort(keys, kind="stable")  # older runs first: smaller documents
            keys, docs = keys[order], docs[order]
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            self.levels.append((keys[first], docs[first]))


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Documents packed in the order they are read: ``chunk, ids, nulls, sizes, blob``."""
    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0
        coder = zstandard.ZstdCompressor(level=3)

        def row():
            return pa.RecordBatch.from_pydict({
                "chunk": [part << 32 | made], "ids": [np.array([_LAST if i is None else i for i in ids], np.int64).tobytes()],
                "nulls": [np.array([i is None for i in ids], bool).tobytes()], "sizes": [np.array(list(map(len, texts)), np.int64).tobytes()],
                "blob": [coder.compress(b"".join(texts))],
            }, schema=pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("ids", "nulls", "sizes", "blob"))]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held >= chunk_bytes:
                    yield row()
                    made, ids, texts, held = made + 1, [], [], 0
        if ids:
            yield row()

    return docs.mapInArrow(run, "chunk long, ids binary, nulls binary, sizes binary, blob binary")


def _opened(row: dict) -> tuple[np.ndarray, list[bytes]]:
    ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
    data = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=int(sizes.sum()) or 1)
    ends = np.cumsum(sizes)
    return ids, [data[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())]


def _suffixes(ids: np.ndarray, texts: list[bytes]):
    """All sampled suffixes of a chunk in ascending order of document: document, position, head."""
    found = [sampled(t) for t in texts]
    order = np.argsort(ids, kind="stable")
    doc = np.repeat(order, [len(found[d][0]) for d in order])
    at = np.concatenate([found[d][0] for d in order])
    head = np.concatenate([found[d][1] for d in order])
    return doc, at, head


def _heads_of(ids, doc, head, parts):
    """Per part: the chunk's distinct heads in sorted order, which are in two documents of it, and how often each occurs."""
    order = np.argsort(head, kind="stable")
    keys, owner = head[order], ids[doc[order]]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    shared = np.maximum.reduceat(owner, first) != np.minimum.reduceat(owner, first) if len(first) else np.zeros(0, bool)
    keys, times = keys[first], np.diff(np.append(first, len(keys)))
    part = (keys % np.uint64(parts)).astype(np.int64)
    for p in np.unique(part).tolist():
        mine = part == p
        yield p, keys[mine], shared[mine], times[mine]


_WIDTH = 5  # bytes of a head that travel; a chance match within a part only costs a comparison


_MANY = 16  # occurrences of a head in a chunk from which they are counted


def _often(times: np.ndarray) -> bytes:
    """Places and counts of the heads that occur more than ``_MANY`` times."""
    where = np.flatnonzero(times > _MANY)
    return np.stack([where, times[where]]).astype("<i8").tobytes()


def _packed(keys: np.ndarray, parts: int) -> bytes:
    return (keys // np.uint64(parts)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH].tobytes()


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _shared_heads(limit: int):
    """Per chunk: a bit for each head, set if another chunk or document has it too, and one,
    if any is set, for those that may occur more than ``limit`` times in all chunks."""
    def fn(table: pa.Table) -> pa.RecordBatch:
        runs = table.column("heads").to_pylist()
        sizes = [len(r) // _WIDTH for r in runs]
        keys = np.zeros((sum(sizes), 8), np.uint8)
        keys[:, :_WIDTH] = np.frombuffer(b"".join(runs), np.uint8).reshape(-1, _WIDTH)
        keys = keys.view("<u8").ravel()
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        ends, times = np.cumsum(sizes), np.full(len(keys), _MANY, np.int64)
        for end, size, often in zip(ends, sizes, table.column("often").to_pylist()):
            where, count = np.frombuffer(often, "<i8").reshape(2, -1)
            times[end - size + where] = count
        first = np.flatnonzero(np.concatenate([[True], ~same])) if len(keys) else np.zeros(0, np.int64)
        hot = np.zeros(len(keys), bool)
        if len(keys):
            hot[order] = np.repeat(np.add.reduceat(times[order], first) > limit, np.diff(np.append(first, len(keys))))
        out, hots = [], []
        for end, size, flags in zip(ends, sizes, table.column("shared").to_pylist()):
            found = twice[end - size:end] | np.unpackbits(np.frombuffer(flags, np.uint8))[:size].astype(bool)
            out.append(np.packbits(found).tobytes())
            mine = found & hot[end - size:end]
            hots.append(np.packbits(mine).tobytes() if mine.any() else b"")
        return pa.RecordBatch.from_pydict({"chunk": table.column("chunk").to_numpy(), "part": table.column("part").to_numpy(), "bits": out, "hot": pa.array(hots, pa.binary())})
    return fn


def _told(row: dict, ids, doc, head, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's shared heads that are not hot, and its hot heads, both sorted."""
    found = {x["part"]: x for x in row["found"]}
    keep, hot = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for p, keys, *_ in _heads_of(ids, doc, head, parts):
        if p in found:
            bits, more = (np.unpackbits(np.frombuffer(found[p][c], np.uint8), count=len(keys)).astype(bool) if found[p][c] else np.zeros(len(keys), bool) for c in ("bits", "hot"))
            keep.append(keys[bits & ~more])
            hot.append(keys[more])
    return np.sort(np.concatenate(keep)), np.sort(np.concatenate(hot))


def _among(head: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, head), len(keys) - 1)] == head if len(keys) else np.zeros(len(head), bool)


def _surroundings(texts, doc, at):
    """The 34 bytes before each place and the 50 from it, and how many of both lie in the text."""
    around = np.zeros((len(at), _SPAN), np.uint8)
    left, right = np.empty(len(at), np.uint8), np.empty(len(at), np.uint8)
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(doc)]):
        data = np.frombuffer(texts[doc[a]], np.uint8)
        wide = np.concatenate([np.zeros(_REACH, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        around[a:b] = np.lib.stride_tricks.sliding_window_view(wide, _SPAN)[at[a:b]]
        left[a:b], right[a:b] = np.minimum(at[a:b], _REACH), np.minimum(len(data) - at[a:b], LENGTH)
    return around, left, right


def _strings(part: np.ndarray, left: np.ndarray, right: np.ndarray):
    """The 50-byte strings that belong to each place: place, bytes before it, hash of the string.

    Only strings of which this head is the least: each string has one such place,
    the same wherever it occurs. A smaller head before or after ends their range.
    """
    back = np.arange(_REACH + 1)  # a string starts so far before the suffix
    made = _doubled(_BYTES[part], (2, 16, 32))
    keys = (made[32][:, :_REACH + 1] * _STEP[16] + made[16][:, 32:32 + _REACH + 1]) * _STEP[2] + made[2][:, 48:48 + _REACH + 1]
    keys = _mix(keys)[:, ::-1]
    head = _mix(made[16])
    smaller = head < head[:, _REACH:_REACH + 1]
    before, after = smaller[:, :_REACH][:, ::-1], smaller[:, _REACH + 1:]
    high = np.minimum(left, np.where(before.any(axis=1), before.argmax(axis=1), _REACH))
    low = np.maximum(LENGTH - np.minimum(right, LENGTH).astype(np.int64), np.where(after.any(axis=1), _REACH - after.argmax(axis=1), 0))
    which, o = np.nonzero((back[None, :] <= high[:, None]) & (back[None, :] >= low[:, None]))
    return which, o, keys[which, o]


def _hot_strings(ids, texts, doc, at, run: int = 8192):
    """The distinct strings at a chunk's hot heads with their smallest documents, and their occurrences:
    number of the string, document, start."""
    keys, docs, begins = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(0, len(at), run):
        some_doc, some_at = doc[start:start + run], at[start:start + run]
        which, o, key = _strings(*_surroundings(texts, some_doc, some_at))
        keys.append(key)
        docs.append(some_doc[which])
        begins.append(some_at[which] - o)
    docs = np.concatenate(docs)
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    owner = np.full(len(distinct), _LAST)
    np.minimum.at(owner, number, ids[docs])
    return distinct, owner, number, docs, np.concatenate(begins)


def _hot_ranges(row: dict, ids, texts, parts: int, subunits: int) -> np.ndarray:
    """The chunk's occurrences of strings at hot heads that a smaller document holds."""
    doc, at, head = _suffixes(ids, texts)
    mine = _among(head, _told(row, ids, doc, head, parts)[1])
    keys, owner, number, docs, begins = _hot_strings(ids, texts, doc[mine], at[mine])
    sub, smaller = (keys % np.uint64(subunits)).astype(np.int64), np.zeros(len(keys), bool)
    for x in row["told"] or ():
        some = np.flatnonzero(sub == -1 - x["unit"])
        smaller[some] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=len(some)).astype(bool)
    gone = smaller[number] | (ids[docs] > owner[number])
    return np.stack([docs[gone], begins[gone], begins[gone] + LENGTH], axis=1)


def _records(row: dict, parts: int, units: int, subunits: int):
    """The chunk's suffixes with a shared head, by unit: distinct surroundings and their occurrences;
    those with a hot head as distinct strings, by a unit (negative) of the string."""
    ids, texts = _opened(row)
    doc, at, head = _suffixes(ids, texts)
    keep, hot = _told(row, ids, doc, head, parts)
    if len(hot):
        mine, coder = _among(head, hot), zstandard.ZstdCompressor(level=3)
        keys, owner, *_ = _hot_strings(ids, texts, doc[mine], at[mine])
        sub = (keys % np.uint64(subunits)).astype(np.int64)
        order = np.argsort(sub, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(sub[order]) > 0])) if len(sub) else []
        for a, b in zip(cuts, [*cuts[1:], len(sub)]):
            some = order[a:b]
            yield {"unit": -1 - int(sub[some[0]]), "chunk": row["chunk"], "n": len(some), "whole": None, "owner": coder.compress(owner[some].tobytes()), "m": 0, "places": coder.compress(keys[some].tobytes())}
    mine = _among(head, keep)
    if not mine.any():
        return
    doc, at, head = doc[mine], at[mine], head[mine]
    around, left, right = _surroundings(texts, doc, at)
    coder = zstandard.ZstdCompressor(level=3)
    unit = (_mix(head) % np.uint64(units)).astype(np.int64)
    for u in np.unique(unit).tolist():
        some = np.flatnonzero(unit == u)
        whole = np.concatenate([around[some], left[some, None], right[some, None]], axis=1)
        # Equal surroundings in the chunk are one record, owned by the smallest document.
        _, first, inverse = np.unique(np.ascontiguousarray(whole).view(f"V{_SPAN + 2}").ravel(), return_index=True, return_inverse=True)
        owner = ids[doc[some[first]]]
        order = np.argsort(owner, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        record = place[inverse]
        yield {
            "unit": u, "chunk": row["chunk"], "n": len(first), "whole": coder.compress(whole[first[order]].tobytes()),
            "owner": coder.compress(owner[order].tobytes()), "m": len(some),
            "places": coder.compress(np.stack([record, doc[some], at[some], ids[doc[some]] == owner[order][record]]).astype("<i4" if at.max() < 2**31 else "<i8").tobytes()),
        }


_RECORDS = "unit long, chunk long, n long, whole binary, owner binary, m long, places binary"


def _matches(run: int):
    """Exact matching inside a unit; returns each chunk's covered ranges as (document, start, end)."""
    def fn(table: pa.Table) -> pa.RecordBatch:
        opened = zstandard.ZstdDecompressor()
        rows = table.to_pylist()
        if rows[0]["unit"] < 0:
            return _least(rows)
        whole = np.concatenate([np.frombuffer(opened.decompress(r["whole"]), np.uint8).reshape(-1, _SPAN + 2) for r in rows])
        owner = np.concatenate([np.frombuffer(opened.decompress(r["owner"]), np.int64) for r in rows])
        hit = np.zeros((len(whole), _REACH + 1), bool)
        order, family = np.argsort(owner, kind="stable"), Family()
        for start in range(0, len(order), run):
            some = order[start:start + run]
            which, o, keys = _strings(whole[some, :_SPAN], whole[some, _SPAN], whole[some, _SPAN + 1])
            docs = owner[some][which]
            by = np.argsort(keys, kind="stable")  # documents ascend, so the first of equals is the smallest
            sorted_keys = keys[by]
            first = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]) if len(by) else np.zeros(0, bool)
            least = docs[by][first]
            seen = np.empty(len(by), bool)
            seen[by] = docs[by] > least[np.cumsum(first) - 1]
            seen |= family.scan(keys, docs)
            hit[some[which[seen]], o[seen]] = True
            family.add(sorted_keys[first], least)
        begin, out = 0, []
        for r in rows:
            width = np.dtype("<i4" if len(p := opened.decompress(r["places"])) == 16 * r["m"] else "<i8")
            record, doc, at, owns = np.frombuffer(p, width).reshape(4, -1).astype(np.int64)
            left, right = whole[begin + record, _SPAN].astype(np.int64), whole[begin + record, _SPAN + 1].astype(np.int64)
            # Another document of the chunk owns the record: all its strings are repeated.
            all_of = (owns == 0) & (LENGTH - right <= left)
            ranges = [np.stack([doc[all_of], at[all_of] - left[all_of], at[all_of] + right[all_of]])]
            own = np.flatnonzero(owns)
            marks = np.pad(hit[begin + record[own]], ((0, 0), (1, 1)))
            where, low = np.nonzero(marks[:, 1:] & ~marks[:, :-1])
            _, high = np.nonzero(marks[:, :-1] & ~marks[:, 1:])
            where = own[where]
            ranges.append(np.stack([doc[where], at[where] - (high - 1), at[where] - low + LENGTH]))
            out.append(np.concatenate(ranges, axis=1).astype(np.int64).T.tobytes())
            begin += r["n"]
        chunks = [r["chunk"] for r, x in zip(rows, out) if x]
        coder = zstandard.ZstdCompressor(level=1)
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([coder.compress(x) for x in out if x], pa.binary())], names=["chunk", "ranges"]).append_column("unit", pa.nulls(len(chunks), pa.int64())).append_column("bits", pa.nulls(len(chunks), pa.binary()))
    return fn


def _least(rows: list[dict]) -> pa.RecordBatch:
    """Per chunk a bit for each of its strings, set if another chunk has it in a smaller document."""
    opened = zstandard.ZstdDecompressor()
    keys = np.concatenate([np.frombuffer(opened.decompress(r["places"]), np.uint64) for r in rows])
    owner = np.concatenate([np.frombuffer(opened.decompress(r["owner"]), np.int64) for r in rows])
    distinct, number = np.unique(keys, return_inverse=True)
    least = np.full(len(distinct), _LAST)
    np.minimum.at(least, number, owner)
    smaller = np.split(least[number] < owner, np.cumsum([r["n"] for r in rows])[:-1])
    return pa.RecordBatch.from_arrays([
        pa.array([r["chunk"] for r in rows], pa.int64()), pa.nulls(len(rows), pa.binary()),
        pa.array([r["unit"] for r in rows], pa.int64()), pa.array([np.packbits(x).tobytes() for x in smaller], pa.binary()),
    ], names=["chunk", "ranges", "unit", "bits"])


def _cut(data: bytes, ranges: np.ndarray) -> tuple[int, int, bytes]:
    """Removed bytes, runs and what is left of a text whose ``ranges`` (start, end) are removed."""
    if not len(ranges):
        return 0, 0, data
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, ranges[:, 0], 1)
    np.add.at(edge, ranges[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def repeated(docs: DataFrame, with_text: bool = False, chunk_bytes: int = 2 << 20, part_bytes: int = 32 << 20, unit_bytes: int = 8 << 20, run: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, binary).

    A byte is removed if it lies in a 50-byte string that also starts in a document of
    a smaller id, judged on the input. Null and empty texts have 0 bytes; a null id
    counts as larger than all others; rows that repeat an id do not repeat each other.

    Texts are packed into compressed chunks, a table in the shared folder. (1) Of all
    suffixes those at minimizers of the 50-byte strings are kept (about one in 18),
    sorted by a hash of their first 16 bytes. The sorted heads of all chunks meet in
    ``parts`` by hash; heads of a single document end there. (2) Suffixes with a shared
    head go, with the 34 bytes before and the 50 from them, to units by head; equal
    surroundings in a chunk travel as one record, so a passage that a third of all
    documents hold costs a record a chunk. In a unit batches of ``run`` suffixes
    in ascending order of document become sorted arrays, are scanned against the
    levels of a logarithmic family, and join it; levels of a size merge. Heads that may
    occur so often that their records alone fill a quarter of a unit go another way:
    a chunk sends each distinct 50-byte string of theirs with its smallest document
    to a unit of the string, and is told by a bit whether a smaller one is elsewhere.
    So a passage of any length, or a frequent phrase, costs a task at most a record a
    string and chunk, whatever surrounds it. (3) Ranges and bits return to their
    chunks. The number of parts and units follows the bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    chunks = written(_chunks(documents(docs, id_col, text_col), chunk_bytes), "text-chunks")
    total = chunks.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    parts, units = max(8, 3 * total // part_bytes), max(8, 3 * total // unit_bytes)
    subunits, limit = 4 * units, unit_bytes // (4 * (_SPAN + 2))

    def heads(batches):
        for row in _rows(batches):
            ids, texts = _opened(row)
            doc, _, head = _suffixes(ids, texts)
            found = list(_heads_of(ids, doc, head, parts))
            yield pa.RecordBatch.from_arrays([
                pa.array([p for p, *_ in found], pa.int64()), pa.array([row["chunk"]] * len(found), pa.int64()),
                pa.array([_packed(k, parts) for _, k, *_ in found], pa.binary()), pa.array([np.packbits(s).tobytes() for _, _, s, _ in found], pa.binary()),
                pa.array([_often(n) for *_, n in found], pa.binary()),
            ], names=["part", "chunk", "heads", "shared", "often"])

    bits = grouped(chunks.mapInArrow(heads, "part long, chunk long, heads binary, shared binary, often binary"), "part", _shared_heads(limit), "chunk long, part long, bits binary, hot binary")
    bits = written(bits, "shared-heads").groupBy("chunk").agg(F.collect_list(F.struct("part", "bits", "hot")).alias("found"))  # at most ``parts`` of a chunk

    def records(batches):
        for row in _rows(batches):
            made = list(_records(row, parts, units, subunits))
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("unit", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("whole", pa.binary()), ("owner", pa.binary()), ("m", pa.int64()), ("places", pa.binary())]))

    wide = chunks.join(bits, "chunk").select("chunk", "ids", "sizes", "blob", "found").mapInArrow(records, _RECORDS)
    ranges = grouped(wide, "unit", _matches(run), "chunk long, ranges binary, unit long, bits binary")
    ranges = ranges.groupBy("chunk").agg(F.collect_list("ranges").alias("ranges"), F.collect_list(F.when(F.col("bits").isNotNull(), F.struct("unit", "bits"))).alias("told"))
    hot = bits.where(F.exists("found", lambda x: F.octet_length(x["hot"]) > 0))

    def answers(batches):
        opened = zstandard.ZstdDecompressor()
        for row in _rows(batches):
            ids, texts = _opened(row)
            null = np.frombuffer(row["nulls"], bool)
            found = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(opened.decompress(x), np.int64).reshape(-1, 3) for x in row["ranges"] or ()), *([_hot_ranges(row, ids, texts, parts, subunits)] if row["found"] else [])])
            found = found[np.argsort(found[:, 0], kind="stable")]
            cuts = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
            done = [_cut(t, found[cuts[d]:cuts[d + 1], 1:]) for d, t in enumerate(texts)]
            columns = {
                "doc_id": pa.array([None if x else int(i) for x, i in zip(null, ids)], pa.int64()), "n_bytes": pa.array(list(map(len, texts)), pa.int64()),
                "n_removed": pa.array([x[0] for x in done], pa.int64()), "n_spans": pa.array([x[1] for x in done], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x[2]).hexdigest() for x in done], pa.string()),
            } | ({"kept": pa.array([x[2] for x in done], pa.binary())} if with_text else {})
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return chunks.join(ranges, "chunk", "left").join(hot, "chunk", "left").select("chunk", "ids", "nulls", "sizes", "blob", "ranges", "told", "found").mapInArrow(answers, schema)
