"""SentencePiece encoding by a batched Viterbi search, and decoding."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import crc_of, documents, map_texts, ship

BLANK = "▁"
#: Stands for a U+2581 of the text itself; a lone surrogate is in no text and no piece.
_LITERAL = "\udfff"
_UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def load(path: str) -> dict:
    """The plain vocabulary of a model file: pieces, scores, byte and unknown ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    return {
        "pieces": [sp.id_to_piece(i) for i in ids],
        "scores": [sp.get_score(i) for i in ids],
        "bytes": {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)},
        "special": [i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)],
        "unknown": sp.unk_id(),
    }


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _BASE + ord(c) + 1) & _MASK
    return h


class Codec:
    """Encodes to the pieces with the largest sum of scores (ties: the longer last piece).

    A text is cut before each run of blanks: no piece reaches over such a cut, so the
    parts are independent. Parts of equal length advance together, one character a
    step; the hash of every substring up to the longest piece probes the sorted hashes
    of all pieces. A character without a piece costs 10 more than the worst piece in
    use (scores below -1e8 mark unused ones) and is written as its UTF-8 bytes. Sums are
    float64, so a costly character does not blur the choices after it.
    """

    def __init__(self, vocabulary: dict, cache: int = 200_000, budget: int = 24 << 20):
        self.pieces, self.byte_ids, self.unknown = vocabulary["pieces"], vocabulary["bytes"], vocabulary["unknown"]
        special = set(vocabulary["special"]) | set(self.byte_ids.values())
        plain = [i for i, p in enumerate(self.pieces) if i not in special and p]
        if any(BLANK in p.lstrip(BLANK) for p in (self.pieces[i] for i in plain)):
            raise ValueError("pieces that hold a blank inside are not supported")
        keys = np.array([_hash(self.pieces[i]) for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain, np.int32)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        self.scores = np.array([vocabulary["scores"][i] for i in plain], np.float64)[order]
        self.lengths = np.array([len(self.pieces[i]) for i in plain], np.int32)[order]
        self.longest = int(self.lengths.max())
        self.unknown_score = self.scores[self.scores > -1e8].min(initial=0) - 10
        self.budget, self.limit = budget, cache
        self.cache, self.older = {}, {}  # two generations of units
        self.output = [b"" if i in set(vocabulary["special"]) else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        for value, i in self.byte_ids.items():
            self.output[i] = bytes([value])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        cut = []
        for text in texts:
            text = text or ""
            if BLANK in text:
                text = text.replace(BLANK, _LITERAL)
            cut.append(_UNIT.findall(BLANK + text.replace(" ", BLANK)) if text else [])
        if len(self.cache) > self.limit:
            self.cache, self.older = {}, self.cache
        known = self.cache
        extra = {}
        missing = {u for units in cut for u in units if u not in known}
        if self.older:
            again = {u: self.older[u] for u in missing if u in self.older}
            known.update(again)
            missing.difference_update(again)
        by_length: dict[int, list[str]] = {}
        for unit in missing:
            by_length.setdefault(len(unit), []).append(unit)
        for length, units in by_length.items():
            step = max(1, self.budget // (length * self.longest * 16))
            for i in range(0, len(units), step):
                part = units[i:i + step]
                (known if length <= 64 else extra).update(zip(part, self._search(part, length)))
        find = known.get if not extra else (lambda u: known.get(u) or extra[u])
        return [np.frombuffer(b"".join(map(find, units)), np.int32) for units in cut]

    def _search(self, units: list[str], length: int) -> list[bytes]:
        n, most = len(units), min(self.longest, length)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).astype(np.uint64)
        prefix = np.zeros((n, length + 1), np.uint64)
        base = np.uint64(_BASE)
        for j in range(length):
            prefix[:, j + 1] = prefix[:, j] * base + codes[:, j] + np.uint64(1)
        # match[:, j, m]: the piece that ends before j + 1 and has most - m characters.
        match = np.full((n, length, most), -1, np.int32)
        gain = np.full((n, length, most), -np.inf)
        power = 1
        for size in range(1, most + 1):
            power = power * _BASE & _MASK
            key = prefix[:, size:] - prefix[:, :length + 1 - size] * np.uint64(power)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (self.lengths[at] == size)
            match[:, size - 1:, most - size] = np.where(hit, self.ids[at], -1)
            gain[:, size - 1:, most - size] = np.where(hit, self.scores[at], self.unknown_score if size == 1 else -np.inf)
        best = np.full((n, length + most), -np.inf)
        best[:, most - 1] = 0  # position 0, after most - 1 places that no path reaches
        back = np.empty((n, length), np.int32)
        rows = np.arange(n)
        for j in range(length):
            path = best[:, j:j + most] + gain[:, j]
            choice = path.argmax(axis=1)  # the first of equals is the longest piece
            back[:, j] = choice
            best[:, j + most] = path[rows, choice]
        # Backtrack all units together.
        at, steps = np.full(n, length), []
        while (live := at > 0).any():
            choice = back[rows, at - 1]
            piece = np.where(live, match[rows, at - 1, choice], -2)
            steps.append((piece, at))
            at = np.where(live, at - (most - choice), 0)
        pieces = np.stack([p for p, _ in steps][::-1], axis=1)
        keep = pieces != -2
        flat, stops = pieces[keep].tobytes(), 4 * np.cumsum(keep.sum(axis=1))
        out = [flat[start:stop] for start, stop in zip([0, *stops[:-1].tolist()], stops.tolist())]
        ends = np.stack([a for _, a in steps][::-1], axis=1)
        for i in np.flatnonzero((pieces == -1).any(axis=1)).tolist():  # characters that no piece spells
            spelt = []
            for piece, stop in zip(pieces[i, keep[i]].tolist(), ends[i, keep[i]].tolist()):
                spelt += [piece] if piece >= 0 else self._bytes(units[i][stop - 1])
            out[i] = np.array(spelt, np.int32).tobytes()
        return out

    def _bytes(self, char: str) -> list[int]:
        char = BLANK if char == _LITERAL else " " if char == BLANK else char
        return [self.byte_ids.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")]

    def decode(self, ids) -> str:
        """The text of ids; the blank that encoding puts first is taken off again."""
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_CODECS: dict[int, Codec] = {}


def _codec(vocabulary: dict) -> Codec:
    """One codec a Python worker: units found serve its later tasks."""
    key = crc_of("\n".join(vocabulary["pieces"]).encode("utf-8", "surrogatepass") + np.array(vocabulary["scores"]).tobytes())
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, ids, n_ids, ids_crc32, round_trip``.

    One narrow pass over whole texts; ``round_trip`` says that decoding the ids gives
    the text again, which holds for every text if the model has all 256 byte pieces.
    Null and empty texts have no ids and decode to the empty text. ``ids_crc32`` is
    over the ids as little-endian unsigned 32-bit integers. The vocabulary is
    broadcast: its size is the model's.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def make():
        codec = _codec(sent.value)

        def fn(columns):
            ids = codec.encode(columns["text"])
            return {
                "doc_id": columns["doc_id"], "ids": ids, "n_ids": [len(x) for x in ids], "ids_crc32": [crc_of(x.tobytes()) for x in ids],
                "round_trip": [codec.decode(x.tolist()) == (t or "") for x, t in zip(ids, columns["text"])],
            }
        return fn

    return map_texts(documents(docs, id_col, text_col), make, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, round_trip boolean")


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of id lists; null lists give the empty text."""
    ship(tokens.sparkSession)
    sent = tokens.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches):
        import pyarrow as pa

        codec = _codec(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [codec.decode(x or ()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
