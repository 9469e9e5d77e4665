"""Benchmark decontamination with spaced seeds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import documents, ship, written

#: A window of WINDOW words with at most SUBSTITUTIONS differences is an overlap. The
#: two masks are lossless for it: whatever two words differ, one mask fits between.
WINDOW, SUBSTITUTIONS = 13, 2
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SHORTEST = 5  # items of fewer words are found only as a whole text
_GAP = np.uint64(2**64 - 1)  # stands between two texts; no window may hold it
_EDGE = np.uint64(2**64 - 2)  # stands between two items, as wide as a window
_MULTIPLIERS = [pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(WINDOW)]
_BACK = WINDOW - 1 - MASKS[0][-1]  # so far before a seed a window that holds it may begin
#: Scripts written without blanks between words (Thai, Lao, Myanmar, Khmer, kana, Han):
#: each character is a word of its own.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_MIXED = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_HITS = 1 << 18  # seed hits looked at together


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits; characters of scripts without blanks stand alone."""
    lowered = (text or "").lower()
    if lowered.isascii() or not _ANY_UNSPACED.search(lowered):
        return re.findall(r"\w+", lowered)
    return [w for w in _MIXED.findall(lowered) if re.match(r"\w", w)]  # no marks and punctuation of these scripts


class Seeds:
    """A block of benchmark items: their words as numbers and their seeds in sorted order.

    Items of fewer than ``WINDOW`` words are looked for whole and unchanged; those of
    fewer than ``SHORTEST`` say too little inside another text, and overlap only a
    text that has no other word.
    """

    def __init__(self, items: list[tuple]):
        self.vocabulary: dict[str, int] = {}
        self.items, self.ids, self.whole, seeds = [], [], {}, {}
        edge = np.full(WINDOW, _EDGE)
        flat, bases, at_end = [edge], [], WINDOW
        for item_id, text in items:
            words = tokens(text)
            if not words:
                continue
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            n = len(self.items)
            self.items.append(numbers)
            self.ids.append(item_id)
            bases.append(at_end)
            flat += [numbers, edge]
            at_end += len(numbers) + WINDOW
            if len(words) < SHORTEST:
                self.whole.setdefault(tuple(numbers.tolist()), []).append(n)
                continue
            masks = MASKS if len(words) >= WINDOW else (tuple(range(len(words))),)
            for mask in masks:
                hashes = spaced(numbers, mask)[0]
                seeds.setdefault(mask, []).append((hashes, np.full(len(hashes), n), np.arange(len(hashes))))
        self.flat, self.bases = np.concatenate(flat), np.array(bases, np.int64)
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        self.seeds = {}
        for mask, parts in seeds.items():
            hashes, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            self.seeds[mask] = hashes[order], item[order], at[order]


def spaced(numbers: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Per position: the hash of the words the mask selects, and whether all are known (not 0)."""
    n = max(0, len(numbers) - mask[-1])
    hashes, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for offset, factor in zip(mask, _MULTIPLIERS):
        part = numbers[offset:offset + n]
        hashes += part * np.uint64(factor)
        known &= (part != 0) & (part != _GAP)
    return hashes, known


def _verified(padded: np.ndarray, seeds: Seeds, where: np.ndarray, item: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which seed hits lie in an overlap: only the words around each hit are compared, all hits at once."""
    text, own = where + WINDOW, seeds.bases[item] + at
    good = np.zeros(len(where), bool)
    wide = seeds.lengths[item] >= WINDOW
    t, b = text[wide], own[wide]
    total, sums = np.zeros(len(t), np.int16), [np.zeros(len(t), np.int16)]
    for offset in range(-_BACK, WINDOW):
        x, y = padded[t + offset], seeds.flat[b + offset]
        total = total + np.where((x == _GAP) | (y == _EDGE), np.int16(-WINDOW), (x == y).astype(np.int16))
        sums.append(total)
    found = np.zeros(len(t), bool)
    for first in range(_BACK + 1):
        found |= sums[first + WINDOW] - sums[first] >= WINDOW - SUBSTITUTIONS
    good[wide] = found
    t, b, size = text[~wide], own[~wide], seeds.lengths[item[~wide]]
    found = np.ones(len(t), bool)
    for offset in range(WINDOW - 1):
        found &= (offset >= size) | (padded[np.minimum(t + offset, len(padded) - 1)] == seeds.flat[b + offset])
    good[~wide] = found
    return good


def _hits(numbers: np.ndarray, seeds: Seeds, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple]:
    """Verified seed hits ``(where, item, at)``, in the order of ``where``, about ``_HITS`` at a time.

    A seed that many items hold meets a text once an item; such hits are compared in
    slices of bounded size, and only verified ones leave. ``wanted`` tells before each
    slice which positions still matter.
    """
    places, starts, counts, items, ats, held = [], [], [], [], [], 0
    for mask, (keys, item, at) in seeds.seeds.items():
        hashes, known = spaced(numbers, mask)
        where = np.flatnonzero(known)
        left = np.searchsorted(keys, hashes[where], "left")
        n = np.searchsorted(keys, hashes[where], "right") - left
        some = n > 0
        places.append(where[some]), starts.append(left[some] + held), counts.append(n[some])
        items.append(item), ats.append(at)
        held += len(keys)
    if not sum(map(len, places)):
        return
    places, starts, counts, items, ats = map(np.concatenate, (places, starts, counts, items, ats))
    order = np.argsort(places, kind="stable")
    places, starts, counts = places[order], starts[order], counts[order]
    ends, begin = np.cumsum(counts), 0
    padded = np.concatenate([np.full(WINDOW, _GAP), numbers, np.full(WINDOW, _GAP)])
    while begin < len(places):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _HITS, "right")))
        where, left, n = places[begin:end], starts[begin:end], counts[begin:end]
        begin = end
        if wanted is not None:
            still = wanted(where)
            where, left, n = where[still], left[still], n[still]
        hit = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        where, item, at = np.repeat(where, n), items[hit], ats[hit]
        good = _verified(padded, seeds, where, item, at)
        if good.any():
            yield where[good], item[good], at[good]


def _short_ones(numbers: np.ndarray, seeds: Seeds) -> Iterator[tuple[int, int, int]]:
    """``(item, first, last)`` of texts that are an item of fewer than ``SHORTEST`` words, and nothing else."""
    if not seeds.whole:
        return
    ends = np.append(np.flatnonzero(numbers == _GAP), len(numbers))
    first = np.append(0, ends[:-1] + 1)
    for start, end in zip(first[ends - first < SHORTEST].tolist(), ends[ends - first < SHORTEST].tolist()):
        for i in seeds.whole.get(tuple(numbers[start:end].tolist()), ()):
            yield i, start, end


def overlaps_of(numbers: np.ndarray, seeds: Seeds) -> Iterator[tuple[int, int, int, int]]:
    """Verified overlaps ``(item, first, last, equal)`` of known-word numbers (0: no benchmark word)."""
    for i, first, last in _short_ones(numbers, seeds):
        yield i, first, last, last - first
    gaps, seen, text = np.flatnonzero(numbers == _GAP), set(), -1
    for where, item, at in _hits(numbers, seeds):
        # Each alignment of an item with the text is told once, over the whole item.
        for n, i, start in np.unique(np.stack([np.searchsorted(gaps, where), item, where - at]), axis=1).T.tolist():
            if n != text:
                seen, text = set(), n
            if (i, start) in seen:
                continue
            seen.add((i, start))
            words = seeds.items[i]
            skip = max(0, -start)
            part = numbers[start + skip:start + len(words)]
            equal = (part == words[skip:skip + len(part)]).astype(np.int64)
            width, allowed = (WINDOW, SUBSTITUTIONS) if len(words) >= WINDOW else (len(words), 0)
            total = np.concatenate([[0], np.cumsum(np.where(part == _GAP, -width, equal))])
            good = np.flatnonzero(total[width:] - total[:-width] >= width - allowed)
            # Runs of good windows, each cut to its first and last equal word.
            for run in np.split(good, np.flatnonzero(np.diff(good) > width) + 1) if len(good) else ():
                inside = run[0] + np.flatnonzero(equal[run[0]:run[-1] + width])
                first, last = int(inside[0]), int(inside[-1]) + 1
                yield i, start + skip + first, start + skip + last, int(equal[first:last].sum())


def find_overlaps(docs: DataFrame, benchmark: DataFrame, block_chars: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """One row an overlap: ``doc_id, item_id, first_word, last_word, n_equal, n_substituted``.

    Word numbers count from 0, ``last_word`` is exclusive. The benchmark is dealt into
    blocks of about ``block_chars`` characters by a hash; each block's seeds are
    broadcast in turn and joined inside the scan of the documents, which are never
    shuffled: memory is bounded, a larger benchmark takes more passes, and the driver
    holds one block. Items of equal text are looked for once and told apart by a join in
    the end. Texts that are null or have no word overlap nothing; repeated rows and items
    are all reported; a document row reports an item once an alignment. A passage that
    many items share is reported with each of them, so the rows grow with these pairs;
    ``decontaminate`` makes none. Items of 1 to 4 words are found only as a whole text,
    of 5 to 12 only whole and unchanged.
    """
    ship(docs.sparkSession)
    base, out = documents(docs, id_col, text_col), None
    items = _items(benchmark, item_col, item_text_col)
    schema = "doc_id long, k1 long, k2 long, first_word long, last_word long, n_equal long, n_substituted long"
    for sent, last in _blocks(items, block_chars):
        one = base.mapInArrow(_scanner(sent, batch_bytes), schema)
        if out is None and last:
            out = one
        else:
            one = written(one, "overlaps")
            sent.destroy()
            out = one if out is None else out.union(one)
    named = items.select("k1", "k2", "item_id")
    return out.join(named, ["k1", "k2"]).select("doc_id", "item_id", "first_word", "last_word", "n_equal", "n_substituted")


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """``item_id, text, k1, k2``: the items that have a text, with 128 bits of its hash."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return items.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def _blocks(items: DataFrame, block_chars: int) -> Iterator[tuple]:
    """One block of different item texts after the other, broadcast, and whether it is the last."""
    context = items.sparkSession.sparkContext
    texts = items.groupBy("k1", "k2").agg(F.min("text").alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // block_chars
    for b in range(blocks):
        block = texts.where(F.pmod("k2", F.lit(blocks)) == b) if blocks > 1 else texts
        yield context.broadcast(sorted(((r.k1, r.k2), r.text) for r in block.collect())), b == blocks - 1


def _numbered(texts: list[str | None], seeds: Seeds) -> tuple[np.ndarray, list[int]]:
    """The words of all texts as numbers, a gap after each text, and where each begins."""
    number = seeds.vocabulary.get
    gap, numbers, begins = [int(_GAP)], [], []
    for text in texts:
        begins.append(len(numbers))
        numbers += [number(w, 0) for w in tokens(text)]
        numbers += gap
    return np.array(numbers, np.uint64), begins


def _pieces(batches, at: int, batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``batch_bytes`` of text."""
    for batch in batches:
        if batch.num_rows:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = (np.flatnonzero(np.diff(ends // batch_bytes)) + 1).tolist()
            for start, end in zip([0, *cuts], [*cuts, len(ends)]):
                yield batch.slice(start, end - start)


def _scanner(sent, batch_bytes: int, most: int = 1 << 15):
    """Overlaps of the columns ``doc_id, text``; ``most`` rows leave at a time."""
    names = ["doc_id", "k1", "k2", "first_word", "last_word", "n_equal", "n_substituted"]

    def run(batches):
        seeds = Seeds(sent.value)
        for part in _pieces(batches, 1, batch_bytes):
            ids, rows = part.column(0).to_pylist(), []
            numbers, begins = _numbered(part.column(1).to_pylist(), seeds)

            def ready():
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

            for item, first, last, equal in overlaps_of(numbers, seeds):
                doc = int(np.searchsorted(begins, first, "right")) - 1
                rows.append((ids[doc], *seeds.ids[item], first - begins[doc], last - begins[doc], equal, last - first - equal))
                if len(rows) == most:
                    yield ready()
                    rows.clear()
            if rows:
                yield ready()
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_chars: int = 4 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """The rows without an overlap, as they are; each is judged by its own text alone.

    Ids play no part, so rows with a null id or one that another row repeats go only
    if they overlap themselves. One scan a block of the benchmark drops rows inside
    it; between scans the rest is written, so that a task and the driver hold one block. A
    text is done with its first overlap, however many items share the passage.
    """
    ship(docs.sparkSession)
    at, rest = docs.columns.index(text_col), docs
    for sent, last in _blocks(_items(benchmark, item_col, item_text_col), block_chars):
        rest = rest.mapInArrow(_cleaner(sent, at, batch_bytes), docs.schema)
        if not last:
            rest = written(rest, "without-block")
            sent.destroy()
    return rest


def _cleaner(sent, at: int, batch_bytes: int):
    def run(batches):
        seeds = Seeds(sent.value)
        for part in _pieces(batches, at, batch_bytes):
            numbers, begins = _numbered(part.column(at).to_pylist(), seeds)
            clean = np.ones(part.num_rows, bool)

            def rows(where):
                return np.searchsorted(begins, where, "right") - 1

            clean[[int(rows(first)) for _, first, _ in _short_ones(numbers, seeds)]] = False
            for where, _, _ in _hits(numbers, seeds, lambda where: clean[rows(where)]):
                clean[rows(where)] = False
            yield part.filter(pa.array(clean))
    return run
