"""Fill-in-middle documents, cut at token boundaries that a Roaring-style set selects."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import map_texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BITS = 16  # of a position inside its container
_BITMAP_BYTES = (1 << _BITS) // 8


class Array:
    """Few positions, one by one."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, i: int) -> int:
        return int(self.low[i])


class Bitmap:
    """Many scattered positions: 64-bit words with the ones up to and in each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << _BITS, bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.ones = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, i: int) -> int:
        word = int(np.searchsorted(self.ones, i, "right"))
        before = int(self.ones[word - 1]) if word else 0
        inside = np.flatnonzero(np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little"))
        return 64 * word + int(inside[i - before])


class Runs:
    """Positions in a row: where each run starts and how many there are up to its end."""

    def __init__(self, low: np.ndarray, begins: np.ndarray):
        self.starts = low[begins].astype(np.uint16)
        self.ends = np.append(begins[1:], len(low))

    def select(self, i: int) -> int:
        run = int(np.searchsorted(self.ends, i, "right"))
        return int(self.starts[run]) + i - (int(self.ends[run - 1]) if run else 0)


class Boundaries:
    """A sorted set of positions: the high bits name a container, the container holds the low ones."""

    def __init__(self, positions: np.ndarray):
        self.keys, first = np.unique(positions >> _BITS, return_index=True)
        self.ends = np.append(first[1:], len(positions)).astype(np.int64)  # cumulative cardinalities
        low = positions & ((1 << _BITS) - 1)
        self.containers = [self._smallest(low[a:b]) for a, b in zip(first, self.ends)]

    @staticmethod
    def _smallest(low: np.ndarray) -> Array | Bitmap | Runs:
        begins = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        if 4 * len(begins) < min(2 * len(low), _BITMAP_BYTES):
            return Runs(low, begins)
        return Array(low) if 2 * len(low) <= _BITMAP_BYTES else Bitmap(low)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def select(self, i: int) -> int:
        """The ``i``-th position, from 0."""
        at = int(np.searchsorted(self.ends, i, "right"))
        return (int(self.keys[at]) << _BITS) + self.containers[at].select(i - (int(self.ends[at - 1]) if at else 0))


def boundaries(text: str) -> Boundaries:
    """Where the tokens ``[A-Za-z]+|[^A-Za-z]`` of a text end, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = (points | 32) - np.uint32(97) < 26
    inside = np.zeros(len(points), bool)  # the token goes on after this code point
    inside[:-1] = letter[:-1] & letter[1:]
    return Boundaries(np.flatnonzero(~inside) + 1)


def transform(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    A text is cut into ``n`` tokens, runs of ASCII letters or single other code points,
    and parted after two of the ``n + 1`` boundaries. ``form`` is ``psm`` (prefix, suffix,
    middle), ``spm`` (suffix, prefix, middle; ``spm_percent`` of those parted) or
    ``plain`` (the text itself; ``plain_percent`` of all, and every text that is empty
    or holds a marker). All draws are groups of the sha256 of ``seed:id``, so rows that
    repeat an id are cut alike and nothing depends on the order of rows.

    A null text counts as empty; a null id draws like an id without digits. The
    boundaries of a text take memory in proportion to it, one text at a time.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.withColumn("drawn", drawn)
    rows = rows.select("doc_id", "text", *[F.conv(F.substring("drawn", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)])

    def make():
        def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
            ends = boundaries(text)
            n = len(ends)
            if not n or h3 % 100 >= 100 - plain_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                return n, "plain", None, None, text
            first, last = (ends.select(k - 1) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
            prefix, middle, suffix = text[:first], text[first:last], text[last:]
            if h4 % 100 < spm_percent:
                return n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
            return n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

        def fn(columns):
            parted = [one(*row) for row in zip(columns["text"], *(columns[f"h{k}"] for k in (1, 2, 3, 4)))]
            names = ("n", "form", "prefix_chars", "middle_chars", "output")
            return {"doc_id": columns["doc_id"]} | {name: [row[i] for row in parted] for i, name in enumerate(names)}
        return fn

    return map_texts(rows, make, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` made ``output`` of.

    A parted text holds no marker, so the first of each kind is where one was put.
    """
    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        size = len(PREFIX)
        one, two = F.locate(second, output), F.locate(MIDDLE, output)
        part = lambda start, end: F.substring(output, start, end - start)
        return part(F.lit(size + 1), one), part(one + size, two), F.substring(output, two + size, F.length(output))

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = between(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))
