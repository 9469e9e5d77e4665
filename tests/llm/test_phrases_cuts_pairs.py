"""Collocations, fill-in-middle cuts and the Hamming join against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import compare
from claimweave.llm import collocations, hamming, middle, queries


@pytest.fixture(scope="module")
def con(tiny):
    return compare.connect(tiny)


@pytest.mark.parametrize("name", ["op11_quotient_collocations", "op12_roaring_middle"])
def test_statement(spark, tiny, con, name):
    assert compare.difference(queries.QUERIES[name](spark, tiny), con, queries.ORACLES[name]) is None


# 11. Counting quotient filters.

@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_permutation_is_invertible(k):
    lanes = np.random.default_rng(k).integers(0, 2**63, (k, 500), dtype=np.uint64)
    lanes[:, :3] = 0
    assert (collocations.restore(collocations.permute(lanes)) == lanes).all()


@pytest.mark.parametrize("k,bits", [(1, 0), (1, 4), (2, 3), (5, 6)])
def test_filters_lose_nothing_and_merge(k, bits):
    rng = np.random.default_rng(k)
    words = rng.integers(0, 30, (k, 4000)).astype(np.uint64)
    want = Counter(map(tuple, words.T.tolist()))
    parts = defaultdict(list)
    for piece in np.array_split(words, 7, axis=1):
        keys, counts = collocations.combine(collocations.permute(piece), np.full(piece.shape[1], 97))
        for value in np.unique(keys[0] >> np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)):
            of = (keys[0] >> np.uint64(64 - bits)) == value if bits else np.ones(len(counts), bool)
            parts[int(value)].append(collocations.QuotientFilter.from_bytes(collocations.QuotientFilter.build(keys[:, of], counts[of], bits).to_bytes()))
    got = Counter()
    for filters in parts.values():
        keys, counts = collocations.merge(filters)
        assert (np.diff(keys[0].astype(object)) >= 0).all()
        for key, count in zip(collocations.restore(keys).T.tolist(), counts.tolist()):
            got[tuple(key)] += count
    assert got == Counter({key: 97 * count for key, count in want.items()})


def test_keys_that_share_the_first_lane_stay_apart():
    keys = np.array([[5, 5, 5, 1], [2, 1, 2, 9]], np.uint64)
    got, counts = collocations.combine(keys, np.array([1, 10, 100, 1000]))
    assert got.T.tolist() == [[1, 9], [5, 1], [5, 2]] and counts.tolist() == [1000, 10, 101]


@given(st.text(alphabet="aB ÄäΣ\t.\n!\x0b\x85 x", max_size=80))
@settings(max_examples=200, deadline=None)
def test_words_of_any_text(text):
    data, make = text.encode(), collocations.Words(0)
    ids, piece, start, end = make(data, "en")
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    pieces = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]
    assert [data[s:e].lower().decode() for s, e in zip(start, end)] == [w for p in pieces for w in p]
    assert Counter(piece.tolist()) == Counter({i: len(p) for i, p in enumerate(pieces) if p})
    assert len(set(ids.tolist())) == len({w for p in pieces for w in p})
    if len(ids):
        assert set(make(data, "de")[0].tolist()).isdisjoint(ids.tolist())


def plain_phrases(rows, least):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for part in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", part)
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i:i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    longest = Counter()
    for (lang, words), a in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                longest[lang, words[i:i + k]] = max(longest[lang, words[i:i + k]], a)
    out = set()
    for (lang, words), a in found.items():
        if longest[lang, words] < a:
            score, k = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
            out.add((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    return out


def test_phrases_of_small_texts(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "The", "cat", "sat", "ÉTÉ", "été", "on", "a", "mat", "b" * 40, "c" * 33])
    rows = [(rng.choice(["en", "de", None]), "".join(word() + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(rng.randrange(60)))) for _ in range(60)]
    rows += [("en", None), (None, ""), ("und", "the cat sat on"), ("en", "The cat sat on a mat " * 30_000)]
    table = spark.createDataFrame([(i, *row, 0, "x") for i, row in enumerate(rows)], "doc_id long, lang string, text string, n long, phrase string").repartition(5)
    got = {tuple(r) for r in collocations.phrases(table, least=4).collect()}
    assert got == plain_phrases(rows, 4) and len(got) > 50
    assert collocations.top_phrases(table.limit(0)).count() == 0


def test_long_texts_are_cut_at_pieces_only():
    text = b"one two three. " * 50 + b"w " * 300 + b"end"
    parts = list(collocations._windows([text, b"", b"x"], 40))
    assert b"".join(parts).replace(b"\n", b"") == text + b"x" and all(p.endswith(b".") for p in parts[:-2])


# 12. Roaring boundaries.

@pytest.mark.parametrize("make", [
    lambda rng: np.arange(200_000), lambda rng: np.flatnonzero(rng.random(300_000) < 0.3), lambda rng: np.flatnonzero(rng.random(300_000) < 0.001),
    lambda rng: np.concatenate([np.arange(70_000, 80_000), [90_000], np.arange(200_000, 200_002)]), lambda rng: np.array([65_535, 65_536]), lambda rng: np.zeros(0, np.int64),
])
def test_select(make):
    positions = make(np.random.default_rng(1))
    found = middle.Boundaries(positions)
    assert len(found) == len(positions)
    for i in {*range(min(3, len(positions))), *random.Random(0).sample(range(len(positions)), min(200, len(positions))), *([len(positions) - 1] if len(positions) else [])}:
        assert found.select(i) == positions[i]


def test_containers_take_the_smallest_form():
    kinds = lambda p: [type(c) for c in middle.Boundaries(np.array(p)).containers]
    assert kinds([3, 9, 70_000]) == [middle.Array, middle.Array] and kinds(range(100)) == [middle.Runs]
    assert kinds(range(0, 40_000, 2)) == [middle.Bitmap]


def plain_middle(doc_id, text):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text or ""
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_transform_and_back(spark, make, odd):
    rng = random.Random(2)
    texts = odd + [(100 + i, "".join(rng.choice(["ab", "<", "S>", "P", ">", "M>", "é", "\U0001f600", " ", "\n"]) for _ in range(rng.randrange(30)))) for i in range(300)]
    texts += [(500, "a<P>b"), (501, "<M>"), (502, "x"), (503, "<")]
    out = middle.transform(make(texts))
    got = out.select("*", middle.restored(out.output, out.form).alias("text")).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *plain_middle(i, t), t or "") for i, t in texts)
    assert {r.form for r in got} == {"plain", "psm", "spm"} and middle.transform(make([])).count() == 0


# 13. Multi-index Hamming join.

def plain_components(rows):
    """``[(doc_id, n_shingles, component_id, kept)]`` by all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + 2]) for i in range(max(1, len(words) - 1))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x] if j < i)
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] += [doc_id] if doc_id is not None else []
    name = [min(least[find(i)], default=None) for i in range(len(rows))]
    return Counter((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, name))


def answers(df):
    return Counter(tuple(r) for r in df.collect())


def test_components_of_a_table(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert answers(queries.QUERIES["op13_hamming_duplicates"](spark, tiny)) == plain_components(rows)


def test_odd_rows(spark, make, odd):
    assert answers(hamming.near_duplicates(make(odd))) == plain_components(odd)
    assert hamming.near_duplicates(make([])).count() == 0
    both = [(7, "a b c d e"), (7, "f g h i j"), (8, "F G H I J"), (None, "a b c d e"), (None, "k l m"), (9, "word"), (10, "WORD"), (11, "other")]
    assert answers(hamming.near_duplicates(make(both))) == plain_components(both)


def test_families_and_chains(spark, make):
    """Families in one bucket whose members are not all linked with a pivot, and chains of links."""
    rng = random.Random(6)
    rows, words = [], [f"w{i}" for i in range(4000)]
    for family in range(6):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(120):  # up to nine of 60 words differ
            copy = list(base)
            for at in rng.sample(range(60), rng.randrange(10)):
                copy[at] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    chain = [rng.choice(words) for _ in range(50)]
    for step in range(60):
        chain = chain[2:] + [rng.choice(words), rng.choice(words)]
        rows.append((len(rows), " ".join(chain)))
    rows += [(5000 + i, f"{a} {b} c d e") for i, (a, b) in enumerate([("x", "y"), ("x", "z")])] + [(6000, "p q r s t u"), (6001, "p q r s t u v")]
    for options in ({"limit": 50}, {"rounds": 1, "tries": 1, "limit": 20}):
        assert answers(hamming.near_duplicates(make(rows), **options)) == plain_components(rows)


def test_signatures_under_the_distance_always_share_a_key(spark):
    """13 of 28 symbols differ, anywhere: some key is common."""
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 16, (400, 28)).astype("<u2")
    two = one.copy()
    for row in two:
        row[rng.permutation(28)[:13]] += np.uint16(1)
    pairs = spark.createDataFrame([(a.tobytes(), b.tobytes()) for a, b in zip(one, two)], "a binary, b binary")
    keys = lambda c: hamming.index_keys(pairs[c], 7, 4, 1)
    from pyspark.sql import functions as F
    got = pairs.select(F.size(F.array_intersect(keys("a"), keys("b"))).alias("n")).collect()
    assert min(r.n for r in got) >= 1
