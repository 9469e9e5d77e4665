"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import math
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.llm.common import documents, map_texts

UNKNOWN = "und"
MIN_MARGIN = 0.002
_BLANKED = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def letters(text: str) -> bytes:
    """UTF-8 of the lower-case text; ASCII runs that are no letters become one blank.

    Empty if the text has no letter of any script.
    """
    lowered = text.lower()
    kept = b" ".join(lowered.encode("utf-8", "surrogatepass").translate(_BLANKED).split())
    if kept.isascii() or any(map(str.isalpha, lowered)):
        return kept
    return b""


@dataclass(frozen=True)
class LanguageModel:
    """One raw-content dictionary a language, all cut to the same size."""

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = 6
    piece: int = 512

    def coder(self):
        tools = [
            (lang, zstandard.ZstdCompressor(level=self.level, write_checksum=False, write_content_size=False,
                                            dict_data=_precomputed(content, self.level)))
            for lang, content in self.dictionaries
        ]

        def ranked(pieces, start):
            # A short piece is doubled, else zstandard would store it as it is.
            pieces = [p + b" " + p if 2 * len(p) < self.piece else p for p in pieces]
            sizes = sorted((start.get(lang, 0) + sum(len(tool.compress(p)) for p in pieces), lang) for lang, tool in tools)
            return sizes if len(sizes) > 1 else [*sizes, (2 * sizes[0][0], "")]

        def predict(text: str | None) -> tuple[str, float, float]:
            """(language, score, margin): the language whose dictionary makes the text smallest."""
            kept = letters(text or "")
            if not kept or not tools:
                return UNKNOWN, 0.0, 0.0
            # Pieces, so that the dictionary counts throughout a long text.
            pieces = [kept[i:i + self.piece] for i in range(0, len(kept), self.piece)]
            sizes = ranked(pieces, {})
            if (sizes[1][0] - sizes[0][0]) < 0.02 * sizes[1][0]:
                # Sizes are whole bytes: a close call is settled by the text's different words, three at a time.
                words = list(dict.fromkeys(kept.split()))
                sizes = ranked([b" ".join(words[i:i + 3]) for i in range(len(words))], {lang: size for size, lang in sizes})
            best, second = sizes[0][0], sizes[1][0]
            margin = (second - best) / second
            return sizes[0][1], 1 / (1 + math.exp(-40 * margin)), margin

        return predict


def _precomputed(content: bytes, level: int) -> zstandard.ZstdCompressionDict:
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=level)
    return made


def fit(labelled: DataFrame, docs_per_language: int = 64, chars_per_doc: int = 1000, max_languages: int = 512, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Dictionaries from a bounded sample of labelled rows.

    The bound: ``docs_per_language`` documents a language, those of over 40 characters
    first, then in the order of a hash of the id, and ``chars_per_doc`` characters of each,
    from its middle; at most ``max_languages`` languages (more raise). Shorter texts thus
    teach where a language has too few longer ones. Only ids move to find the sample. Rows
    with a null language, id or text teach nothing, nor does a language without a letter; of
    rows that repeat an id and a language the smallest excerpt counts. All dictionaries are
    cut to the size of the smallest that has a quarter of the full size or more.
    """
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    order = Window.partitionBy("lang").orderBy("short", F.xxhash64("doc_id"), "doc_id")
    picked = rows.select("lang", "doc_id", (F.length("text") <= 40).alias("short")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_language)
    picked = picked.select("lang", "doc_id").distinct().limit(max_languages * docs_per_language + 1)
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - chars_per_doc) / 2)).cast("int")
    sample = rows.join(F.broadcast(picked), ["lang", "doc_id"]).select("lang", "doc_id", F.substring("text", middle, F.lit(chars_per_doc)).alias("text"))
    by_lang: dict[str, list] = {}
    # At most max_languages * docs_per_language rows of chars_per_doc characters.
    for lang, doc_id, text in sample.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).orderBy("lang", "doc_id").limit(max_languages * docs_per_language + 1).collect():
        by_lang.setdefault(lang, []).append(letters(text))
    if len(by_lang) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    built = {lang: b" ".join(texts) for lang, texts in by_lang.items() if any(texts)}
    full = max(map(len, built.values()), default=0)
    size = min((len(b) for b in built.values() if 4 * len(b) >= full), default=0)
    # A cut may fall inside a character; the dictionary is bytes, so that is harmless.
    return LanguageModel(tuple((lang, built[lang][-size:]) for lang in sorted(built)))


def identify_rows(docs: DataFrame, model: LanguageModel, min_margin: float = MIN_MARGIN, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``_lang_pred, _score, _margin, _rejected`` added; one narrow pass.

    Whole texts. ``_margin`` is how much smaller the best size is than the second,
    ``_score`` rises with it from 0.5 to 1. ``_rejected`` marks margins below
    ``min_margin`` and texts without a letter or null: those get ``und``, score 0. Ties
    go to the language that sorts first; without languages all get ``und``.
    """
    dictionaries = docs.sparkSession.sparkContext.broadcast((model.dictionaries, model.level, model.piece))  # bounded by fit()
    keep = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    types = [docs.schema[c].dataType.simpleString() for c in docs.columns]
    schema = ", ".join([f"c{i} {t}" for i, t in enumerate(types)] + ["_lang_pred string", "_score double", "_margin double", "_rejected boolean"])

    def make():
        predict = LanguageModel(*dictionaries.value).coder()

        def fn(columns):
            found = [predict(t) for t in columns.pop("text")]
            return columns | {
                "_lang_pred": [x[0] for x in found], "_score": [x[1] for x in found], "_margin": [x[2] for x in found],
                "_rejected": [x[0] == UNKNOWN or x[2] < min_margin for x in found],
            }
        return fn

    out = map_texts(docs.select(*keep, F.col(text_col).cast("string").alias("text")), make, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], "_lang_pred", "_score", "_margin", "_rejected")


def identify(docs: DataFrame, model: LanguageModel, min_margin: float = MIN_MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, lang_pred, score, margin, rejected``, as in ``identify_rows``."""
    rows = identify_rows(documents(docs, id_col, text_col), model, min_margin)
    return rows.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("lang_pred", "score", "margin", "rejected")])
