"""Phrase collocations counted in counting quotient filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import bitmap, grouped, in_bitmap, map_texts, ship, written

LONGEST = 5  # words of a phrase
NO_LANG = "und"
_LONG_WORD = 32  # bytes; longer words are hashed one by one
_STEP = 0x9E3779B97F4A7C15
_ROUNDS = tuple((np.uint64(a), np.uint64(b)) for a, b in ((0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)))
_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 a blank, 2 the end of a piece
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _mix(x: np.ndarray, multipliers=_ROUNDS[0]) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * multipliers[0]
    x = (x ^ (x >> np.uint64(27))) * multipliers[1]
    return x ^ (x >> np.uint64(31))


# Packed n-grams: ``k`` lanes of 64 bits, one word id each.

def permute(lanes: np.ndarray) -> np.ndarray:
    """An invertible permutation of ``64 k`` bits, ``lanes`` of shape ``(k, n)``: each lane in turn
    takes in a mix of the one before it, twice around; lane 0 then depends on all."""
    out = lanes.copy()
    for step, multipliers in enumerate(_ROUNDS):
        for i in range(len(out)):
            out[i] ^= _mix(out[i - 1] + np.uint64(step + 1), multipliers) if len(out) > 1 else np.uint64(step + 1)
    out[0] = out[0] * np.uint64(_STEP)
    return out


def restore(permuted: np.ndarray) -> np.ndarray:
    """The lanes that ``permute`` got."""
    out = permuted.copy()
    out[0] = out[0] * np.uint64(pow(_STEP, -1, 1 << 64))
    for step, multipliers in reversed(list(enumerate(_ROUNDS))):
        for i in reversed(range(len(out))):
            out[i] ^= _mix(out[i - 1] + np.uint64(step + 1), multipliers) if len(out) > 1 else np.uint64(step + 1)
    return out


def combine(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Permuted keys in ascending order, each once, with the sums of their counts."""
    if not len(counts):
        return keys, counts
    order = np.argsort(keys[0], kind="stable")
    sorted_keys = keys[:, order]
    tied = sorted_keys[0, 1:] == sorted_keys[0, :-1]
    new = ~tied
    for lane in sorted_keys[1:]:
        new = new | (lane[1:] != lane[:-1])
    if (new & tied).any():  # different keys that share their first lane
        order = np.lexsort(keys[::-1])
        sorted_keys = keys[:, order]
        new = (sorted_keys[:, 1:] != sorted_keys[:, :-1]).any(axis=0)
    begins = np.flatnonzero(np.concatenate([[True], new]))
    return sorted_keys[:, begins], np.add.reduceat(counts[order], begins)


class QuotientFilter:
    """An immutable counting quotient filter over the permuted keys of one range.

    The range is given by the first ``prefix`` bits. The next ``q`` bits are the quotient: a bit
    a quotient says whether it is occupied, a bit an entry whether it ends its run. The entry
    keeps the whole remainder (the other bits of the first lane and all other lanes), so
    nothing is lost and the key can be read back. Counts are one byte; larger ones are
    kept apart, in order.
    """

    def __init__(self, prefix: int, value: int, q: int, occupied: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray, small: np.ndarray, large: np.ndarray):
        self.prefix, self.value, self.q = prefix, value, q
        self.occupied, self.run_ends, self.remainders, self.small, self.large = occupied, run_ends, remainders, small, large

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, prefix: int) -> QuotientFilter:
        """From ``combine``'s output, all of whose keys share their first ``prefix`` bits."""
        n = len(counts)
        q = min(max(1, int(n).bit_length()), 63 - prefix)
        head = keys[0]
        value = int(head[0]) >> (64 - prefix) if prefix else 0
        quotient = (head << np.uint64(prefix)) >> np.uint64(64 - q)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        run_ends = np.append(quotient[1:] != quotient[:-1], True)
        size = cls._head_bytes(prefix, q)
        rest = head & np.uint64((1 << (64 - prefix - q)) - 1)
        parts = [np.ascontiguousarray(rest[:, None]).view(np.uint8)[:, :size], *(np.ascontiguousarray(lane[:, None]).view(np.uint8) for lane in keys[1:])]
        small = np.minimum(counts, 255).astype(np.uint8)
        return cls(prefix, value, q, np.packbits(occupied), np.packbits(run_ends), np.concatenate(parts, axis=1), small, counts[counts >= 255].astype("<i8"))

    @staticmethod
    def _head_bytes(prefix: int, q: int) -> int:
        return (64 - prefix - q + 7) // 8

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Permuted keys, ascending, and their counts."""
        n = len(self.small)
        ends = np.unpackbits(self.run_ends, count=n).astype(bool)
        run = np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int64)
        quotient = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.q)).astype(np.uint64)[run]
        size = self._head_bytes(self.prefix, self.q)
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :size] = self.remainders[:, :size]
        free = np.uint64(64 - self.prefix - self.q)
        head = (quotient << free) | rest.view("<u8")[:, 0]
        if self.prefix:
            head |= np.uint64(self.value << (64 - self.prefix))
        others = [np.ascontiguousarray(self.remainders[:, at:at + 8]).view("<u8")[:, 0] for at in range(size, self.remainders.shape[1], 8)]
        counts = self.small.astype(np.int64)
        counts[self.small == 255] = self.large
        return np.stack([head, *others]), counts

    def to_bytes(self) -> bytes:
        n, lanes = len(self.small), (self.remainders.shape[1] - self._head_bytes(self.prefix, self.q)) // 8
        header = np.array([n, lanes, self.prefix, self.value, self.q, len(self.large)], "<i8")
        return b"".join(x.tobytes() for x in (header, self.occupied, self.run_ends, self.remainders, self.small, self.large))

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        n, lanes, prefix, value, q, larges = np.frombuffer(data, "<i8", 6).tolist()
        width, at, parts = cls._head_bytes(prefix, q) + 8 * lanes, 48, []
        for size in (((1 << q) + 7) // 8, (n + 7) // 8, n * width, n):
            parts.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        return cls(prefix, value, q, parts[0], parts[1], parts[2].reshape(n, width), parts[3], np.frombuffer(data, "<i8", larges, at))


def merge(filters: list[QuotientFilter]) -> tuple[np.ndarray, np.ndarray]:
    """The items of several filters of one range, counts of equal keys added."""
    items = [f.items() for f in filters]
    return combine(np.concatenate([k for k, _ in items], axis=1), np.concatenate([c for _, c in items]))


# Texts to word ids.

class Words:
    """Word ids of texts: 64-bit hashes of a language and a word, all bytes at a time."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed + 11)
        self.table = (rng.integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1))[_LOWER]
        self.base = int(rng.integers(1, 2**62)) * 4 + 3
        self.seed, self.powers, self.inverse = seed, self._powers(self.base, 1 << 16), self._powers(pow(self.base, -1, 1 << 64), 1 << 16)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out, done = np.ones(n, np.uint64), 1
        while done < n:
            step = min(done, n - done)
            out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        return out

    def __call__(self, data: bytes, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``ids, piece, start, end`` of the words in lower-cased ``data``; ``piece`` numbers pieces."""
        if len(data) > len(self.powers):
            size = 1 << len(data).bit_length()
            self.powers, self.inverse = self._powers(self.base, size), self._powers(pow(self.base, -1, 1 << 64), size)
        raw = np.frombuffer(data, np.uint8)
        kind = _KIND[raw]
        edge = np.diff((kind == 0).astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.table[raw] * self.powers[:len(raw)], out=total[1:])
        ids = (total[end] - total[start]) * self.inverse[start]
        ids = _mix(ids + (end - start).astype(np.uint64) * np.uint64(_STEP))
        for i in np.flatnonzero(end - start > _LONG_WORD).tolist():
            ids[i] = xxhash.xxh64_intdigest(data[start[i]:end[i]].lower(), self.seed + 1)
        ids = _mix(ids ^ np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), self.seed)))
        return ids, np.cumsum(kind == 2)[start], start, end


def _windows(texts: list[bytes], size: int) -> Iterator[bytes]:
    """Texts joined to strings of about ``size`` bytes. Pieces stay whole: a longer text is cut
    behind the end of a piece, and one without such an end is one string."""
    held, total = [], 0
    for text in texts:
        start = 0
        while len(text) - start > 2 * size:
            cut = next((i for i in range(start + size, len(text)) if _KIND[text[i]] == 2), len(text) - 1) + 1
            yield text[start:cut]
            start = cut
        held.append(text[start:])
        total += len(text) - start
        if total >= size:
            yield b"\n".join(held)
            held, total = [], 0
    if held:
        yield b"\n".join(held)


def _by_lang(columns: dict[str, list]) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {}
    for text, lang in zip(columns["text"], columns["lang"]):
        if text:
            out.setdefault(NO_LANG if lang is None else lang, []).append(text.encode("utf-8", "surrogatepass"))
    return out


def packed(ids: np.ndarray, piece: np.ndarray, k: int, shorter: np.ndarray | None) -> np.ndarray:
    """Permuted keys of the phrases of ``k`` words inside pieces whose two parts of ``k - 1``
    words may be frequent (``shorter`` is their bitmap; None lets all pass)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros((k, 0), np.uint64)
    keep = piece[k - 1:] == piece[:n]
    if shorter is not None:
        part = permute(np.stack([ids[i:i + n + 1] for i in range(k - 1)]))[0]
        hit = in_bitmap(shorter, part)
        keep &= hit[:-1] & hit[1:]
    at = np.flatnonzero(keep)
    return permute(np.stack([ids[at + i] for i in range(k)]))


def _count(docs: DataFrame, k: int, seed: int, bits: int, shorter: bytes | None, flush: int = 3 << 20) -> DataFrame:
    """A task's filters of phrases of ``k`` words, one for each of ``2**bits`` ranges of keys:
    ``range, filter``; for ``k = 1`` also rows ``lang, n`` with its word occurrences."""
    marked = docs.sparkSession.sparkContext.broadcast(shorter) if shorter is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(seed)
        known = np.frombuffer(marked.value, np.uint8) if marked is not None else None
        keys, counts, totals, held = [], [], {}, 0

        def filters() -> pa.RecordBatch:
            merged, sums = combine(np.concatenate(keys, axis=1), np.concatenate(counts))
            ranges = (merged[0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sums), np.int64)
            cuts = np.flatnonzero(np.diff(ranges)) + 1
            blobs = [QuotientFilter.build(merged[:, a:b], sums[a:b], bits).to_bytes() for a, b in zip([0, *cuts], [*cuts, len(sums)])]
            return pa.RecordBatch.from_pydict({
                "range": ranges[np.concatenate([[0], cuts])].tolist(), "filter": blobs, "lang": [None] * len(blobs), "n": [None] * len(blobs)}, schema=schema)

        for batch in batches:
            part = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for lang, texts in _by_lang(part).items():
                for data in _windows(texts, 1 << 20):
                    ids, piece, _, _ = words(data, lang)
                    totals[lang] = totals.get(lang, 0) + len(ids)
                    found = packed(ids, piece, k, known)
                    if not found.shape[1]:
                        continue
                    once, sums = combine(found, np.ones(found.shape[1], np.int64))
                    keys.append(once)
                    counts.append(sums)
                    held += len(sums)
                    if held >= flush:
                        once, sums = combine(np.concatenate(keys, axis=1), np.concatenate(counts))
                        keys, counts, held = [once], [sums], len(sums)
                        if held >= flush // 2:
                            yield filters()
                            keys, counts, held = [], [], 0
        if held:
            yield filters()
        if k == 1 and totals:
            yield pa.RecordBatch.from_pydict({"range": [None] * len(totals), "filter": [None] * len(totals), "lang": list(totals), "n": list(totals.values())}, schema=schema)

    schema = pa.schema([("range", pa.int64()), ("filter", pa.binary()), ("lang", pa.string()), ("n", pa.int64())])
    return docs.mapInArrow(run, "range long, filter binary, lang string, n long")


def _frequent(counted: DataFrame, least: int) -> DataFrame:
    """``words`` (ids), ``slot`` (first lane of the permuted key) and ``f`` of the phrases counted ``least`` times or more."""
    def fn(table):
        keys, counts = merge([QuotientFilter.from_bytes(f) for f in table.column("filter").to_pylist()])
        often = counts >= least
        if not often.any():
            return None
        keys, counts = keys[:, often], counts[often]
        lanes = restore(keys).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(list(lanes.T), pa.list_(pa.int64())), pa.array(keys[0].view(np.int64)), pa.array(counts)], names=["words", "slot", "f"])

    return grouped(counted.where("range IS NOT NULL").select("range", "filter"), "range", fn, "words array<long>, slot long, f long")


def _spelled(docs: DataFrame, ids: DataFrame, seed: int) -> DataFrame:
    """``id, lang, word, spelled`` of the word ids in ``ids``; ``spelled`` counts their different spellings."""
    marked = docs.sparkSession.sparkContext.broadcast(bitmap(ids, "id"))

    def make():
        words, bits, sent = Words(seed), np.frombuffer(marked.value, np.uint8), set()

        def fn(columns):
            out = {"id": [], "lang": [], "word": []}
            for lang, texts in _by_lang(columns).items():
                for data in _windows(texts, 1 << 20):
                    got, _, start, end = words(data, lang)
                    for i in np.flatnonzero(in_bitmap(bits, got)).tolist() if len(got) else ():
                        word = data[start[i]:end[i]].lower()
                        if (lang, word) not in sent:
                            sent.add((lang, word))
                            for name, value in zip(out, (int(got[i].astype(np.int64)), lang, word.decode("utf-8", "surrogatepass"))):
                                out[name].append(value)
            return out
        return fn

    found = map_texts(docs, make, "id long, lang string, word string").groupBy("id", "lang", "word").agg(F.lit(1).alias("one"))
    found = found.groupBy("id").agg(F.min(F.struct("lang", "word")).alias("x"), F.count("*").alias("spelled"))
    return found.join(ids, "id", "left_semi").select("id", "x.lang", "x.word", "spelled")


def phrases(docs: DataFrame, least: int = 100, share: int = 100, scale: int = 1000, lang_col: str = "lang", text_col: str = "text", attempts: int = 4) -> DataFrame:
    """Collocations, all of them: ``lang, phrase, a, l, r, n, score``.

    A-Z are lowered, texts cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words
    at blanks and tabs. Everything is counted per language (null: ``und``). Candidates are
    phrases of 2 to 5 words that occur ``a >= least`` times; of all cuts into ``l`` and ``r``
    occurrences of the parts the one with the lowest ``floor(scale a n / (l r))`` counts, the
    first of equal ones. Dropped are phrases inside a longer candidate with at least
    ``share`` percent of their occurrences. Null and empty texts hold no words.

    A word's id is a 64-bit hash of language and word. Phrases of ``k`` words are packed
    into ``k`` ids, permuted invertibly and counted in quotient filters, one a task and key range;
    filters of a range are merged. As a phrase is no more frequent than its parts, longer phrases
    are counted only where both parts of one word less may be frequent, told by a
    bitmap of 4 MB whatever the data: a full one only counts more. That two spellings share an id
    is looked for in the end among all words that phrases hold; the count is then
    repeated with other hashes (``attempts`` times, then it raises).
    """
    for seed in range(attempts):
        found, spelled = _phrases(docs, least, share, scale, lang_col, text_col, seed)
        if spelled.where("spelled > 1").isEmpty():
            return found
    raise ValueError("different words share a hash under every seed")


def _phrases(docs: DataFrame, least: int, share: int, scale: int, lang_col: str, text_col: str, seed: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    bits = max(4, (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    counted = written(_count(rows, 1, seed, bits, None), "word-filters")
    sizes = counted.where("n IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    levels = [written(_frequent(counted, least), "frequent-1")]
    for k in range(2, LONGEST + 1):
        # Phrases of k words: both their parts of k - 1 words are among the last level's.
        levels.append(written(_frequent(_count(rows, k, seed, bits, bitmap(levels[-1], "slot")), least), f"frequent-{k}"))
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.union(level)
    counts = counts.select("words", "f")
    found = counts.where("size(words) > 1")
    ids = found.select(F.explode("words").alias("id")).distinct()
    spelled = written(_spelled(rows, ids, seed), "words")

    # The cuts of a phrase, with the counts of both parts.
    cuts = found.select("words", "f", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("words", "f", "k", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select(F.col("words").alias("first"), F.col("f").alias("l")), "first").join(counts.select(F.col("words").alias("rest"), F.col("f").alias("r")), "rest")
    # Inside a longer candidate: enough to look at those of one word more, since counts only fall.
    inside = found.where("size(words) > 2").select("f", F.explode(F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1))).alias("words"))
    inside = inside.groupBy("words").agg(F.max("f").alias("longer"))
    kept = found.join(inside, "words", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * share)).select("words")

    spelt = kept.select("words", F.posexplode("words").alias("i", "id")).join(spelled, "id")
    spelt = spelt.groupBy("words").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(spelt, "words").join(sizes, "lang")
    product = (F.col("f") * F.lit(scale)).cast("decimal(19,0)") * wide("n")
    scored = scored.withColumn("over", product).withColumn("under", wide("l") * wide("r")).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("words", "lang", "phrase", "f", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", F.col("f").alias("a"), "x.l", "x.r", "n", "x.score"), spelled


def top_phrases(docs: DataFrame, first: int = 2000, **options) -> DataFrame:
    """The ``first`` phrases of each language by score, then occurrences, then the phrase in byte
    order: ``lang, rank, phrase, a, l, r, n, score``. Cut by ``first`` in parts of a language
    before the language's own ranking, so no task gets a whole language."""
    order = (F.desc("score"), F.desc("a"), "phrase")
    rows = phrases(docs, **options).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
