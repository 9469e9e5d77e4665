"""The registered queries of this subpackage: thin views of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import collocations, decontam, hamming, jaccard, langid, lines, middle, quality, rules, sharding, spm, suffix, wavelet
from claimweave.llm.common import id_remainder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer lies; only its name is fixed here."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_wavelet_shards(spark, sf):
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    path = wavelet.write_shards(table(spark, sf, "documents"), tokenizer, end_id=1)
    return wavelet.read_documents(spark, path)


@query
def op2_quality_neighbours(spark, sf):
    """Labels teach only where the id's remainder by 3 is not 1."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    taught = labels.where(id_remainder(F.col("doc_id"), 3) != 1).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, taught)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@query
def op4_rule_ledger(spark, sf):
    rows = rules.apply_policy(rules.ledger(table(spark, sf, "documents")), 2)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("bits").bitwiseAND(F.lit(rules.mask(rules.BASE)).cast("long")) != 0).alias("base_failed"), "kept",
        "bits", "blocking", "policy", "n_lines", "n_alpha_words", "n_upper_words",
    )


# Failure bits are those of rules.RULES; policy 2 enforces bits 0, 1, 4, 6 and 7.
ORACLES["op4_rule_ledger"] = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
windows AS (
  SELECT r, i, list_slice(words, i, i + 2) AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
),
hits AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM hits) GROUP BY r),
lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: len(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.dup, 0)::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS n_lines,
    len(list_filter(words, lambda x: regexp_matches(x, '\pL')))::BIGINT AS n_alpha_words,
    len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x)))::BIGINT AS n_upper_words
  FROM w LEFT JOIN repeats p USING (r) LEFT JOIN lines l USING (r)
),
b AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (word_chars < 2 * n_words)::BIGINT
    + 8 * (word_chars > 15 * n_words)::BIGINT + 16 * (10 * n_symbols > n_words)::BIGINT + 32 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
    + 64 * (10 * n_alpha_words < 6 * n_words)::BIGINT + 128 * (2 * n_upper_words > n_words)::BIGINT AS bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, (bits & 211) = 0 AS kept,
  bits, bits & 211 AS blocking, 2 AS policy, n_lines, n_alpha_words, n_upper_words
FROM b
"""


@query
def op6_hash_tree_shards(spark, sf):
    shards = sharding.tree(16)
    out = sharding.shard_documents(table(spark, sf, "documents"), shards, sharding.grow(shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


@query
def op7_language_by_compression(spark, sf):
    """Languages are learnt where the id's remainder by 5 is not 0; ``und`` only without a letter."""
    docs = table(spark, sf, "documents")
    model = langid.fit(docs.where(id_remainder(F.col("doc_id"), 5) != 0))
    found = langid.identify(docs, model)
    return found.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query
def op5_sentencepiece_viterbi(spark, sf):
    """Every text encoded and decoded again."""
    return spm.encode(table(spark, sf, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op8_spaced_seed_overlaps(spark, sf):
    """Only documents that overlap a benchmark item, with each overlap."""
    return decontam.find_overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op3_chosen_path_join(spark, sf):
    return jaccard.similar(table(spark, sf, "documents"))


@query
def op9_fuzzy_lines(spark, sf):
    """Every line that is removed, with the line that stays for it."""
    return lines.duplicate_lines(table(spark, sf, "documents"))


@query
def op10_suffix_family(spark, sf):
    return suffix.repeated(table(spark, sf, "documents"))


@query
def op12_roaring_middle(spark, sf):
    """Digests of the output, and of the text rebuilt from it."""
    out = middle.transform(table(spark, sf, "documents"))
    text = middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


ORACLES["op12_roaring_middle"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex
  FROM documents
),
h AS (
  SELECT doc_id, text, tokens, len(tokens) AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2,
    ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4
  FROM t
),
c AS (
  SELECT doc_id, text, n,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(tokens[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
    array_to_string(tokens[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
    array_to_string(tokens[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix
  FROM h
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""


@query
def op13_hamming_duplicates(spark, sf):
    return hamming.near_duplicates(table(spark, sf, "documents"))


@query
def op11_quotient_collocations(spark, sf):
    return collocations.top_phrases(table(spark, sf, "documents"))


ORACLES["op11_quotient_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS words FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(words) >= k)
),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
sizes AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1),
inside AS (
  SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, words, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS m) WHERE m < k) GROUP BY ALL
),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(words[:cut], ' ') AS first, array_to_string(words[cut + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, l.f AS l, r.f AS r, n, ((1000 * a::HUGEINT * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = first JOIN f r ON r.lang = cuts.lang AND r.phrase = rest JOIN sizes ON sizes.lang = cuts.lang
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
