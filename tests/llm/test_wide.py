"""The operators that compare documents, and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimweave.llm import decontam, jaccard, langid, lines, queries, spm, suffix
from claimweave.llm.common import components, shared_dir, written


def union_find(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.fixture(scope="module")
def corpus(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


def pairs_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


@pytest.mark.parametrize("links", [
    [], [(5, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(29, 50)],
    [(random.Random(i).randrange(60), random.Random(-i).randrange(60)) for i in range(45)],
])
def test_components(spark, links):
    want = {x: r for x, r in union_find([(a, b) for a, b in links if a != b]).items()}
    got = components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


# 3. Chosen-path join.

def slow_groups(rows, threshold=0.8):
    sets = [(d, {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", t or "")) else set()) for d, t in rows if d is not None]
    sets = [(d, s) for d, s in sets if s]
    links = [(a, b) for (a, s), (b, t) in combinations(sets, 2) if len(s & t) >= threshold * len(s | t) - 1e-9]
    counts = Counter(x for pair in links for x in pair)
    return counts, union_find(links)


def check_groups(frame, **options):
    rows = pairs_of(frame)
    counts, roots = slow_groups(rows)
    got = jaccard.similar(frame, **options).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_links, r.class_id) == (counts[r.doc_id], roots.get(r.doc_id, r.doc_id)), r
        else:
            assert (r.n_links, r.class_id) == (0, None)
    return got


def test_join_on_the_table(corpus):
    check_groups(corpus)


def near_copies(n, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        yield i, " ".join(words)


def test_join_splits_large_buckets(make):
    """A group larger than a bucket is split, then compared block by block; counts stay exact."""
    texts = [*near_copies(90), *((i, f"only {i} here " * 3 + " ".join(f"v{i}{k}" for k in range(20))) for i in range(200, 260))]
    got = check_groups(make(texts), limit=16)
    assert max(r.n_links for r in got) > 50


def test_join_odd_rows(make, odd):
    once = {d: (d, t) for d, t in odd}.values()
    check_groups(make([*once, (20, "three words only"), (21, "three  words\nonly"), (22, "Three words only")]))
    twice = jaccard.similar(make(odd)).collect()
    assert len(twice) == len(odd) and {r.class_id for r in twice if r.doc_id == 5} == {5}
    assert jaccard.similar(make([])).count() == 0


def test_keep_one(make):
    texts = [(3, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "q r s t u v w"), (None, "a b c d e f g h"), (4, None), (5, "")]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in jaccard.keep_one(make(texts)).collect()) == [(False, 1), (False, 2), (False, 4), (False, 5), (True, 0)]


def test_keep_one_of_repeated_rows(make):
    a, b, c = "a b c d e f g h", "q r s t u v w", "k l m n o p"
    texts = [(1, a), (1, a), (2, a), (1, b), (1, b), (None, c), (None, c), (None, c), (7, c), (7, c), (None, "x y z 1 2 3")]
    got = Counter((r.doc_id, r.text) for r in jaccard.keep_one(make(texts)).collect())
    assert got == Counter([(1, a), (1, b), (None, c), (7, c), (None, "x y z 1 2 3")])


def test_runs_reach_the_recall():
    assert jaccard.runs_for(0.9999, 0.8, 2) == 10
    assert 1 - (1 - 0.8**3) ** jaccard.runs_for(0.999, 0.8, 3) >= 0.999


# 8. Spaced seeds.

def test_masks_are_lossless():
    for differ in combinations(range(decontam.WINDOW), decontam.SUBSTITUTIONS):
        assert any(not {s + m for m in mask} & set(differ) for mask in decontam.MASKS for s in range(decontam.WINDOW - mask[-1]))


def slow_overlaps(docs, items):
    found = set()
    for d, text in docs:
        words = decontam.tokens(text)
        for i, item in items:
            other = decontam.tokens(item)
            if len(other) < decontam.SHORTEST:
                continue
            width, allowed = (13, 2) if len(other) >= 13 else (len(other), 0)
            for at in range(len(words) - width + 1):
                for of in range(len(other) - width + 1):
                    if sum(a == b for a, b in zip(words[at:at + width], other[of:of + width])) >= width - allowed:
                        found.add((d, i))
    return found


def test_overlaps(spark, make, odd):
    rng = random.Random(5)
    items = [(i, " ".join(f"t{rng.randrange(30)}" for _ in range(n))) for i, n in enumerate([13, 14, 20, 40, 6, 4, 12, 13])]
    items += [(8, items[3][1]), (9, None), (None, "one two three four five six seven"), (11, "")]
    texts = [*odd]
    for k in range(120):
        words = [f"t{rng.randrange(30)}" for _ in range(rng.randrange(5, 60))]
        item = (items[k % 8][1]).split()
        cut = item[rng.randrange(2):len(item) - rng.randrange(2)]
        for _ in range(rng.randrange(4)):
            cut[rng.randrange(len(cut))] = "changed"
        texts.append((100 + k, " ".join(words[:7] + cut + words[7:]).replace(" t1 ", ", T1! ")))
    texts.append((500, "Before: one two three, four five six seven!"))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    docs = make(texts)
    want = slow_overlaps([t for t in texts if t[0] not in (4, 9)], items)
    got = decontam.find_overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 60
    assert all(r.n_equal + r.n_substituted == r.last_word - r.first_word for r in got)
    blocks = decontam.find_overlaps(docs, bench, block_chars=200).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == want
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - {d for d, _ in want}
    assert decontam.find_overlaps(make([]), bench).count() == 0 and decontam.find_overlaps(docs, bench.limit(0)).count() == 0


def test_decontaminate_judges_each_row(spark, make):
    item = " ".join(f"w{i}" for i in range(20))
    clean = [(None, "clean text without an id"), (None, None), (1, "clean text that repeats an id"), (2, "")]
    docs = make([*clean, (None, f"before {item} after"), (1, item), (3, f"{item} {item}")])
    bench = spark.createDataFrame([(1, item), (2, item.replace("w", "v"))], "item_id long, text string")
    for options in ({}, {"block_chars": 60}, {"batch_bytes": 10}):
        kept = decontam.decontaminate(docs, bench, **options)
        assert kept.schema == docs.schema
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(clean)


def test_items_with_one_template(spark, make, monkeypatch):
    """Thousands of items and texts share a passage: each text is judged in bounded slices."""
    template = " ".join(f"shared{i}" for i in range(16))
    own = lambda kind, n: " ".join(f"{kind}{n}x{i}" for i in range(12))
    items = [(n, f"{template} {own('item', n)}") for n in range(2000)]
    texts = [(n, f"before {template} {own('text', n)}") for n in range(2000)]
    # Eight shared words are no overlap, though they hold the seeds of all items.
    clean = [(5000 + n, f"{own('a', n)} {' '.join(template.split()[:8])} {own('b', n)}") for n in range(200)]
    bench = spark.createDataFrame([*items, *items[:50]], "item_id long, text string").coalesce(4)
    kept = decontam.decontaminate(make([*texts, *clean]).repartition(4), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in clean}
    few = make([*texts[:3], *clean[:3]])
    pairs = decontam.find_overlaps(few, bench)
    assert pairs.count() == 3 * 2050 and pairs.select("doc_id").distinct().count() == 3

    seeds = decontam.Seeds(items[:300])
    numbers, _ = decontam._numbered([t for _, t in texts[:20] + clean[:5]] + [items[7][1]], seeds)
    whole = sorted(decontam.overlaps_of(numbers, seeds))
    monkeypatch.setattr(decontam, "_HITS", 1000)
    assert sorted(decontam.overlaps_of(numbers, seeds)) == whole and len(whole) == len(set(whole)) == 21 * 300


def test_short_items_and_scripts_without_blanks(spark, make):
    items = [(1, "Yes, it is"), (2, "one two three four five"), (3, "\u6625\u7720\u4e0d\u89c9\u6653\u5904\u5904\u95fb\u557c\u9e1f\u591c\u6765\u98ce\u96e8\u58f0"), (4, "?!"), (5, None), (None, "no id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    changed = list(items[2][1])
    changed[6] = "\u4e00"
    docs = make([(10, "yes it IS!"), (11, "Oh yes, it is so."), (12, "zero one two three four five six"), (13, "one two three four six"),
                 (14, "\u5531" + "".join(changed) + "\u3002"), (15, "\u6625\u7720\u4e0d\u89c9"), (16, ""), (17, None), (18, "No id"), (18, "another text"), (None, "yes it is")])
    got = {(r.doc_id, r.item_id) for r in decontam.find_overlaps(docs, bench).collect()}
    assert got == {(10, 1), (12, 2), (14, 3), (18, None), (None, 1)}
    kept = Counter(r.doc_id for r in decontam.decontaminate(docs, bench).collect())
    assert kept == Counter([11, 13, 15, 16, 17, 18])
    assert decontam.tokens("ab\u4e2d\u6587cd \u3002") == ["ab", "\u4e2d", "\u6587", "cd"]


def test_overlap_query(spark, tiny, corpus):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    joined = {i: " ".join(decontam.tokens(t)) for i, t in items}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op8_spaced_seed_overlaps"](spark, tiny).collect()}
    whole = {(d, i) for d, text in pairs_of(corpus) for i, t in joined.items() if t in " ".join(decontam.tokens(text))}
    assert whole <= got


# 9. Lines.

def slow_lines(rows, threshold=0.8):
    places = defaultdict(list)
    for d, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for i, line in enumerate(t.split("\n")):
            if line.strip(" \t\n\x0b\x0c\r") and (d, i) not in places[line]:
                places[line].append((d, i))
    texts = [x for x in places if places[x]]
    sets = [{x[i:i + 5] for i in range(len(x) - 4)} if len(x) >= 5 else {x} for x in texts]
    order = Counter(g for s in sets for g in s)
    heads, links = defaultdict(list), []
    for x, s in enumerate(sets):
        rare = sorted(s, key=lambda g: (order[g], g))[:len(s) - -(-8 * len(s) // 10) + 1]
        for y in {y for g in rare for y in heads[g]}:
            common = len(s & sets[y])
            if common >= threshold * (len(s) + len(sets[y]) - common) - 1e-9:
                links.append((y, x))
        for g in rare:
            heads[g].append(x)
    roots = union_find(links)
    first = {}
    for x, text in enumerate(texts):
        root = roots.get(x, x)
        first[root] = min(first.get(root, places[text][0]), places[text][0])
    return {p: first[roots.get(x, x)] for x, text in enumerate(texts) for p in places[text] if p != first[roots.get(x, x)]}


def check_lines(frame):
    want = slow_lines(pairs_of(frame))
    got = lines.duplicate_lines(frame).collect()
    assert {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in got} == want
    return want


def test_lines_on_the_table(corpus):
    assert len(check_lines(corpus)) > 50


def test_fuzzy_lines(make, odd):
    rng = random.Random(8)
    texts = [(d, t) for d, t in odd if d not in (4, 9)]
    for k in range(40):
        words = [f"{rng.choice(['al', 'be', 'ga', 'de'])}{rng.randrange(900)}" for _ in range(rng.choice([2, 6, 14, 30, 80]))]
        edited = list(words)
        edited[rng.randrange(len(words))] += "s"
        texts.append((100 + k, " ".join(words) + "\n\nok\n" + " ".join(edited) + "\n" + " ".join(edited) + " "))
    docs = make(texts)
    gone = check_lines(docs)
    kept = lines.drop_duplicate_lines(docs)
    assert kept.columns == docs.columns
    want = Counter()
    for d, t in texts:
        rest = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        touched = t is not None and d is not None and any((d, i) in gone for i in range(t.count("\n") + 1))
        if not touched or rest.strip(" \t\n\x0b\x0c\r"):
            want[d, rest] += 1
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    assert lines.duplicate_lines(make([])).count() == 0 and lines.drop_duplicate_lines(make([])).count() == 0


def test_rows_that_repeat_an_id_lose_only_their_own_lines(spark):
    line = "this line is the one repeated here"
    texts = [(0, line), (1, f"first of the texts\n{line}"), (1, "second of the texts\nan unrelated line that nobody repeats"), (None, line), (1, f"first of the texts\n{line}")]
    names = ["doc_id", "text", "_id", "_row", "_gone", "_text", "a.b", "text_hash", "rest"]
    docs = spark.createDataFrame([(d, t, *range(len(names) - 2)) for d, t in texts], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in names[2:]))
    kept = lines.drop_duplicate_lines(docs)
    assert kept.columns == names and all(tuple(r)[2:] == tuple(range(len(names) - 2)) for r in kept.collect())
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(0, line), (1, "first of the texts"), (1, "first of the texts"), texts[2], (None, line)])


def test_long_lines(make, odd):
    got = {(r.doc_id, r.line_no, r.kept_doc_id) for r in lines.duplicate_lines(make(odd)).collect()}
    assert {(9, 0, 4), (5, 1, 5), (5, 3, 5)} <= got


def matrix_lines(texts, threshold=0.8):
    """Per line the first of its component, from one product of incidence matrices."""
    sets = [{x[i:i + 5] for i in range(max(1, len(x) - 4))} for x in texts]
    column = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    hold = np.zeros((len(sets), len(column)), np.float32)
    for i, s in enumerate(sets):
        hold[i, [column[g] for g in s]] = 1
    common, size = hold @ hold.T, hold.sum(axis=1)
    links = np.argwhere(np.triu(common >= threshold * (size[:, None] + size[None, :] - common) - 1e-4, 1)).tolist()
    return union_find(links), len(links)


def test_template_lines(make):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 8)))
    notice = [word() for _ in range(30)]
    family = [[*notice[:k], *(word() for _ in range(5)), *notice[k:]] for k in [12] * 2400]
    copies = [[*x[:14], word(), *x[15:]] for x in family[:600]]
    texts = [" ".join(x) for x in family + copies]
    roots, n = matrix_lines(texts)
    assert 600 <= n < 5000
    got = {r.doc_id: r.kept_doc_id for r in lines.duplicate_lines(make(list(enumerate(texts)))).collect()}
    assert got == {x: r for x, r in roots.items() if x != r}
    few = lines.duplicate_lines(make(list(enumerate(texts[2000:2600]))), block=50).collect()
    assert {r.doc_id: r.kept_doc_id for r in few} == {x: r for x, r in matrix_lines(texts[2000:2600])[0].items() if x != r}


def test_lines_of_a_family_rarely_meet(make, spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    notice = [word() for _ in range(40)]
    texts = []
    for _ in range(400):
        words = list(notice)
        for i in rng.sample(range(40), rng.choice([1, 6])):
            words[i] = word()
        texts.append(" ".join(words))
    roots, _ = matrix_lines(texts)
    before = set(Path(shared_dir(spark)).glob("line-meetings-*"))
    got = {r.doc_id: r.kept_doc_id for r in lines.duplicate_lines(make(list(enumerate(texts)))).collect()}
    assert got == {x: r for x, r in roots.items() if x != r}
    new, = set(Path(shared_dir(spark)).glob("line-meetings-*")) - before
    assert spark.read.parquet(str(new)).count() < len(texts) ** 2 / 20


def chance_lines(n, copies):
    """Lines that have half of their words in common, and some of them again with another word."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    common = [word() for _ in range(18)]
    family = [[*common, *(word() for _ in range(16))] for _ in range(n)]
    return [" ".join(x) for x in family + [[*x[:25], word(), *x[26:]] for x in family[:copies]]]


def test_families_by_chance_are_not_cut_into_prefixes(make, monkeypatch):
    texts = chance_lines(400, 60)
    want = {x: r for x, r in matrix_lines(texts)[0].items() if x != r}
    assert len(want) == 60
    write = lines.written
    # Smaller blocks; and prefixes wherever a family is larger than a block.
    for block, row in ((1024, lines.ROW), (50, lines.ROW), (50, 0)):
        rows = {}
        monkeypatch.setattr(lines, "ROW", row)
        monkeypatch.setattr(lines, "written", lambda df, name: rows.setdefault(name, write(df, name)))  # noqa: B023
        got = {r.doc_id: r.kept_doc_id for r in lines.duplicate_lines(make(list(enumerate(texts))), block=block).collect()}
        assert got == want
        assert rows["line-nearest"].count() >= len(texts) / 2
        assert (rows["line-differences"].count() > 0) == (row == 0)
        assert (rows["line-prefixes"].count() > len(texts)) == (row == 0)


def test_the_line_stage_cuts_no_prefixes_for_families_by_chance(make, monkeypatch):
    texts = chance_lines(300, 20)
    docs = make([(i, f"{x}\n{hashlib.sha256(x.encode()).hexdigest()}") for i, x in enumerate(texts)])
    rows, write = {}, lines.written
    monkeypatch.setattr(lines, "written", lambda df, name: rows.setdefault(name, write(df, name)))
    left = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.unique_lines(docs.sparkSession, docs, "").collect()}
    assert set(left) == set(range(len(texts)))
    assert {i for i, x in enumerate(texts) if x not in left[i][0]} == set(range(300, 320))
    assert all(n == len(t) for t, n in left.values())
    assert rows["line-prefixes"].count() < len(texts)


def test_crowded_families_miss_no_similar_pair(spark):
    texts = chance_lines(90, 40)
    sets = [{x[i:i + 5] for i in range(len(x) - 4)} for x in texts]
    similar = {(a, b) for a in range(len(texts)) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    df = spark.createDataFrame([(i, i // 2 * 2 if i < 20 else i, x) for i, x in enumerate(texts)], "k1 long, root long, line string")
    family = [(i, p, 100 if p else 30) for p in (0, 1) for i in (range(100) if p else range(30, 130, 3))]
    members = spark.createDataFrame(family, "k1 long, pivot long, m long")
    both = [{i for i, p, _ in family if p == q} for q in (0, 1)]
    want = {x for x in similar if any(set(x) <= f for f in both)}
    assert len(want) > 10
    for block in (7, 1024):
        found = lines._crowded(members, df, 0.8, block).collect()
        assert {(r.a, r.b) for r in found} == want and len(found) == len(want)


def test_other_texts_stay_where_they_are(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("k1"), F.col("id").cast("string").alias("line"))
    keys = rows.where("line % 200 = 7 OR k1 = 0").select("k1").union(spark.createDataFrame([(-1,), (0,), (2**63 - 1,), (-2**63,)], "k1 long"))
    rows = rows.union(spark.createDataFrame([(-1, "a"), (0, "b"), (2**63 - 1, "c"), (-2**63, "d")], "k1 long, line string"))
    got = {tuple(r) for r in lines._maybe(rows, keys).collect()}
    want = {tuple(r) for r in rows.join(keys, "k1", "left_semi").collect()}
    assert len(want) == 104 and want <= got and len(got) < 150
    assert lines._maybe(rows, keys.limit(0)).count() == 0


def test_marks_keep_every_similar_pair(spark):
    rng = random.Random(6)
    texts = []
    for n in (1, 3, 12, 40, 90):
        for _ in range(30):
            words = [f"{rng.choice(['al', 'be', 'ga', 'de'])}{rng.randrange(90)}" for _ in range(n)]
            edited = list(words)
            for _ in range(rng.randrange(1 + n // 10)):
                edited[rng.randrange(n)] += "s"
            texts += [" ".join(words), " ".join(edited) + rng.choice(["", ".", "-----------"])]
    df = spark.createDataFrame(list(enumerate(texts)), "k1 long, line string")
    every = df.select(F.col("k1").alias("a")).join(df.select(F.col("k1").alias("b")), F.col("a") > F.col("b"))
    sets = [{x[i:i + 5] for i in range(max(1, len(x) - 4))} for x in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    close = lines._marked(every, lines._marks(df), 0.8).cache()
    got = {(r.a, r.b): r.total for r in close.collect()}
    assert len(want) > 50 and want <= set(got) and len(got) < 0.1 * len(texts) ** 2 / 2
    assert all(total == len(sets[a]) + len(sets[b]) for (a, b), total in got.items())
    assert {(r.a, r.b) for r in lines._similar(close, df, 0.8).collect()} == want


def test_bands_of_some_lines_are_compared_where_they_meet(make, monkeypatch):
    # 40 lines of one template, some of them copies but for a word: no line is left to the prefixes.
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 8)))
    notice = [word() for _ in range(30)]
    family = [[*notice[:12], *(word() for _ in range(5)), *notice[12:]] for _ in range(30)]
    texts = [" ".join(x) for x in family + [[*x[:14], word(), *x[15:]] for x in family[:10]]]
    rows, write = {}, lines.written
    monkeypatch.setattr(lines, "written", lambda df, name: rows.setdefault(name, write(df, name)))
    got = {r.doc_id: r.kept_doc_id for r in lines.duplicate_lines(make(list(enumerate(texts)))).collect()}
    assert got == {x: r for x, r in matrix_lines(texts)[0].items() if x != r} and len(got) >= 10
    assert rows["line-rest"].count() == 0


def test_short_lines(make):
    texts = ["-----", "--------", "-" * 300, "======", "=====", "Continue", "Continue.", "Chapter 1", "Chapter 10", "abcdefghi", "abcdefghij", "abcd", "abc", "abcde"]
    rng = random.Random(4)
    for _ in range(150):
        x = "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(5, 25)))
        texts += [x, x + "!", "?" + x]
    want = {x: r for x, r in matrix_lines(texts)[0].items() if x != r}
    assert want[1] == 0 and want[2] == 0 and want[6] == 5
    assert {r.doc_id: r.kept_doc_id for r in lines.duplicate_lines(make(list(enumerate(texts)))).collect()} == want


def test_lines_are_native(corpus):
    assert "Python" not in lines.duplicate_lines(corpus)._jdf.queryExecution().executedPlan().toString()


# 10. Repeated bytes.

def slow_repeats(rows):
    least = {}
    big = 1 << 70
    data = [(big if d is None else d, d, (t or "").encode()) for d, t in rows]
    for key, _, b in data:
        for i in range(len(b) - 49):
            least[b[i:i + 50]] = min(key, least.get(b[i:i + 50], key))
    out = Counter()
    for key, d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if least[b[i:i + 50]] < key:
                gone[i:i + 50] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def answers(frame, **options):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated(frame, **options).collect())


def test_repeats_on_the_table(corpus):
    assert answers(corpus) == slow_repeats(pairs_of(corpus))


def test_repeats_in_small_chunks_and_batches(make, odd):
    rng = random.Random(2)
    shared = "".join(rng.choice("abcd efg") for _ in range(300))
    texts = [(d, t) for d, t in odd if d not in (4, 9)]
    for k in range(60):
        a = rng.randrange(250)
        texts.append((rng.randrange(40), "".join(rng.choice("xyz ") for _ in range(rng.randrange(60))) + shared[a:a + rng.randrange(45, 120)] + "ab" * rng.randrange(40) + "é" * rng.randrange(40)))
    docs = make(texts)
    want = slow_repeats(texts)
    assert answers(docs) == want
    assert answers(docs, chunk_bytes=500, part_bytes=100, unit_bytes=100, run=16) == want
    assert suffix.repeated(make([])).count() == 0
    kept = suffix.repeated(docs, with_text=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept)


def test_hot_heads(make, monkeypatch):
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, phrase = some(60), some(16)
    texts = [(i % 390 if i % 50 else None, some(150) + (passage if i % 3 == 0 else phrase if i % 3 == 1 else "") + some(150)) for i in range(600)]
    held, plain = [], suffix.grouped

    def watched(df, key, *rest):
        if key == "unit":
            held.append(df.groupBy("unit").agg({"n": "sum"}).agg({"sum(n)": "max"}).first()[0])
        return plain(df, key, *rest)

    monkeypatch.setattr(suffix, "grouped", watched)
    assert answers(make(texts), chunk_bytes=20_000, unit_bytes=20_000) == slow_repeats(texts)
    assert held[0] < 150  # a third of the documents are 200


def test_long_repeats(make, odd):
    got = {r.doc_id: r for r in suffix.repeated(make(odd)).collect() if r.doc_id in (4, 6, 9)}
    assert got[4].n_removed == 0 and got[6].n_removed == 0
    assert got[9].n_removed == got[9].n_bytes - len("end") and got[9].n_spans == 1


def test_family_keeps_few_levels():
    family, rng, seen = suffix.Family(), np.random.default_rng(4), {}
    for doc in range(64):
        keys = np.unique(rng.integers(0, 3000, 50, dtype=np.uint64))
        docs = np.full(len(keys), doc)
        assert family.scan(keys, docs).tolist() == [k in seen for k in keys.tolist()]
        family.add(keys, docs)
        for k in keys.tolist():
            seen.setdefault(k, doc)
    assert len(family.levels) <= 12


# The pipeline: each stage against a plain version on its own input.

def test_pipeline(spark, tiny, corpus):
    docs = corpus
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = pairs_of(docs)
        out = written(stage(spark, docs, tiny), f"test-{name}")
        if number < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after = dict(pairs_of(out))
        if name == "language_id":
            predict = langid.fit(docs.where("lang IS NOT NULL")).coder()
            assert after == {d: t for d, t in before if (p := predict(t))[0] != "und" and p[2] >= langid.MIN_MARGIN}
        elif name == "line_dedup":
            gone = slow_lines(before)
            rest = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in before}
            assert after == {d: rest[d] for d, t in before if rest[d] == t or rest[d].strip()}
        elif name == "near_duplicates":
            roots = slow_groups(before)[1]
            assert after == {d: t for d, t in before if roots.get(d, d) == d}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
            seeds = decontam.Seeds(items)
            hit = {d for d, t in before if list(decontam.overlaps_of(np.array([seeds.vocabulary.get(w, 0) for w in decontam.tokens(t)], np.uint64), seeds))}
            assert after == {d: t for d, t in before if d not in hit}
        else:
            codec = spm.Codec(spm.load(queries.tokenizer_path("piece_bpe_32k.model")))
            assert {r.doc_id: codec.decode(r.ids) for r in out.collect()} == dict(before)
        docs = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, tiny).select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
