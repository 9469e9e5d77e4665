"""Fuzzy line dedup by MinHash, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import BITMAP_BITS, components, documents, written

SHINGLE = 5
BRIEF = 25  # different shingles of a line that sketches tell too little of
LEAF = 16  # lines of a leaf that are all compared with each other
LANES = 4  # longs of a line's mark
WIDE = 16  # longs of the mark of a family's line
ROW = 400  # pairs of marks that may be compared at the cost of two rows of a prefix; an estimate
SLOT_BITS = 17  # size of the table of shingle counts: 131,072 longs, however many shingles there are


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, line_no, at, line, k1, k2``: lines that hold a word; ``at`` orders
    them by document and position and tells texts of one id apart, ``k1, k2`` are 128 bits of hash."""
    rows = documents(docs, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.withColumns({"at": F.struct("doc_id", "text_hash", "line_no"), "k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), "line")})


def _sketch(hashes: Column, keep: int) -> Column:
    """The ``keep`` least hashes of a set of shingles: a bottom-k MinHash signature."""
    return F.slice(F.array_distinct(F.sort_array(hashes)), 1, keep)


def _bands_of(sketch: Column, kind: int) -> Column:
    """Neighbours in the sketch: two sets share a band if two minima in a row are common."""
    n = F.size(sketch)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(F.lit(kind), F.element_at(sketch, i), F.element_at(sketch, i + 1)))
    return F.when(n > 1, pairs).when(n == 1, F.array(F.xxhash64(F.lit(kind), F.element_at(sketch, 1)))).otherwise(F.array().cast("array<bigint>"))


def sketches(df: DataFrame, keep: int) -> DataFrame:
    """Adds the sketches ``whole`` and ``starts`` of ``line``, either may be NULL.

    Longer lines are sketched from the nine characters after each blank, short ones and
    those with few blanks from every eight characters; lines of 60 to 160 characters
    from both, so that a close pair has one kind in common.
    """
    line = F.col("line")
    length = F.length(line)
    blanks = length - F.length(F.replace(line, F.lit(" "), F.lit("")))
    every = F.regexp_extract_all(line, F.lit(r"(?s)(?=(.{8}))"), F.lit(1))
    starts = F.regexp_extract_all(F.concat(F.lit(" "), line), F.lit(r"(?s) (?=(.{9}))"), F.lit(1))
    hashed = lambda grams: _sketch(F.transform(grams, lambda g: F.hash(g)), keep)
    return df.withColumns({
        "whole": F.when((length < 160) | (blanks * 25 < length), hashed(every)), "starts": F.when(length >= 60, hashed(starts)),
    })


def bands() -> Column:
    """Band keys of a line from its two sketch columns."""
    none = F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(F.coalesce(_bands_of(F.col("whole"), 0), none), F.coalesce(_bands_of(F.col("starts"), 1), none)))


def _cuts(line: Column) -> Column:
    """All ``SHINGLE``-character shingles, as 64-bit hashes (longs make sets in half the
    time of texts); a shorter line is one shingle. Four bytes a character make every place a
    plain offset; the outer ``transform`` encodes a line once."""
    width = 4 * SHINGLE
    cut = lambda u: F.transform(F.sequence(F.lit(1), F.length(u) - (width - 1), F.lit(4)), lambda i: F.xxhash64(F.substring(u, i, F.lit(width))))
    every = F.element_at(F.transform(F.array(F.encode(line, "UTF-32")), cut), 1)
    return F.when(F.length(line) < SHINGLE, F.array(F.xxhash64(line))).otherwise(every)


def grams(line: Column) -> Column:
    """The set of a line's shingles."""
    return F.array_distinct(_cuts(line))


def _brief(line: Column) -> Column:
    """Whether a line has up to ``BRIEF`` different shingles; most are told by their first 40 characters."""
    few = lambda part: F.size(grams(part)) <= BRIEF
    return F.when(F.length(line) < BRIEF + SHINGLE, True).when(few(F.left(line, F.lit(40))), few(line)).otherwise(False)


def _alike() -> Column:
    """Whether the sketches of ``a`` and ``b`` agree as far as a similar pair's would.

    Two lines may share a band by chance; a pair at the threshold has under three
    minima in common with probability about 0.001. Sketches of under four minima always pass.
    """
    few = lambda c: F.least(F.size(f"{c}_a"), F.size(f"{c}_b")) < 4
    alike = lambda c: F.coalesce(few(c) | (F.size(F.array_intersect(f"{c}_a", f"{c}_b")) > 2), F.lit(False))
    return alike("whole") | alike("starts")


def _pairs_in(df: DataFrame, key: str, when: Column | None = None) -> DataFrame:
    """All pairs ``(a, b)``, ``a > b``, of the rows of ``df`` that share ``key``."""
    side = lambda k: df.select(*[F.col(c).alias(k if c == "k1" else c if c == key else f"{c}_{k}") for c in df.columns])
    ordered = F.col("a") > F.col("b")
    return side("a").join(side("b"), key).where(ordered if when is None else ordered & when).select("a", "b")


def _met(held: DataFrame, sketched: DataFrame, small: int) -> DataFrame:
    """Pairs ``(a, b)`` of lines that share a band of up to ``small`` lines and whose sketches agree."""
    # Sketches travel to the bands, where they drop most pairs before these move.
    near = held.where(F.col("n") <= small).select("k1", "band").join(sketched, "k1").repartition("band")
    return _pairs_in(near, "band", _alike())


def _leaves(held: DataFrame, sketched: DataFrame, small: int) -> DataFrame:
    """``k1, leaf, n``: bands of over ``small`` lines, split by every third minimum of a line's sketch.

    A pair that ``_alike`` lets pass has three minima in common, so it shares a leaf. Sketches
    of up to five minima keep the band itself as well, for partners that have only one or two.
    """
    def split(sketch: Column, kind: int) -> Column:
        at = lambda i: F.element_at(sketch, i)
        crowded = F.filter(F.sequence(F.lit(1), F.size(sketch) - 1), lambda i: F.array_contains("crowded", F.xxhash64(F.lit(kind), at(i), at(i + 1))))
        third = lambda i: F.filter(sketch, lambda m: (m != at(i)) & (m != at(i + 1)))
        three = F.transform(crowded, lambda i: F.transform(third(i), lambda m: F.xxhash64(F.lit(kind), F.sort_array(F.array(at(i), at(i + 1), m)))))
        none = F.array().cast("array<bigint>")
        short = F.when(F.size(sketch) <= 5, F.array_intersect(_bands_of(sketch, kind), "crowded")).otherwise(none)
        return F.coalesce(F.concat(F.when(F.size(sketch) > 1, F.flatten(three)).otherwise(none), short), none)

    many = held.where(F.col("n") > small).groupBy("k1").agg(F.collect_set("band").alias("crowded")).join(sketched, "k1")
    leaves = many.select("k1", F.explode(F.array_distinct(F.concat(split(F.col("whole"), 0), split(F.col("starts"), 1)))).alias("leaf")).repartition("leaf")
    return leaves.join(leaves.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"), "leaf").select("k1", "leaf", "n")


def _families(leaves: DataFrame, most: int, groups: DataFrame | None = None) -> DataFrame:
    """``k1, pivot``: each line of a leaf of over ``most`` lines with the leaf's pivot, the line
    that most such leaves hold; with ``groups``, that of the root that most lines of the leaf have,
    which is near to these. Leaves alike have few pivots between them."""
    big = leaves.where(F.col("n") > most).select("k1", "leaf")
    weights = big.groupBy("k1").agg(F.count("*").alias("leaves"))
    central = F.max(F.struct("leaves", "k1")).getField("k1").alias("pivot")
    if groups is None:
        pivots = big.join(weights, "k1").groupBy("leaf").agg(central)
        return big.join(pivots, "leaf").select("k1", "pivot").distinct()
    rooted = weights.join(groups.withColumnRenamed("node", "k1"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    main = big.join(rooted, "k1").groupBy("leaf", "root").agg(F.count("*").alias("m")).groupBy("leaf").agg(F.max(F.struct("m", "root")).getField("root").alias("root"))
    pivots = main.join(rooted.groupBy("root").agg(central), "root")
    return big.join(pivots, "leaf").select("k1", "pivot").distinct()


def _drawn(families: DataFrame, redraws: int) -> DataFrame:
    """Pairs ``(a, b)`` of the lines of a family with its pivot and with ``redraws`` of its lines, drawn by hash."""
    draws = families.select("pivot", "k1", F.explode(F.sequence(F.lit(1), F.lit(redraws))).alias("draw"))
    key = F.xxhash64("pivot", "draw")
    least = draws.groupBy("pivot", "draw").agg(F.min(F.col("k1").bitwiseXOR(key)).alias("least"))
    drawn = families.join(least, "pivot").select("k1", F.col("least").bitwiseXOR(key).alias("other"))
    drawn = drawn.union(families.select("k1", "pivot")).where("k1 <> other")
    return drawn.select(F.greatest("k1", "other").alias("a"), F.least("k1", "other").alias("b"))


def _marks(texts: DataFrame, lanes: int = LANES) -> DataFrame:
    """``k1, n, m0`` and so on: how many different shingles a line has, and the parities of 64
    times ``lanes`` classes of them. Each shingle that only one of two lines has turns one bit."""
    t = F.col("t")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    lane = F.pmod(F.shiftrightunsigned("t", 6), F.lit(lanes))
    marks = [F.bit_xor(F.when(lane == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i in range(lanes)]
    return texts.select("k1", F.explode(grams(F.col("line"))).alias("t")).groupBy("k1").agg(F.count("*").cast("int").alias("n"), *marks)


def _near(threshold: float, lanes: int = LANES) -> Column:
    """Whether sizes and marks of ``a`` and ``b`` let them reach the threshold; never false for a pair that does.

    At least as many shingles are in one line only as bits differ, and a similar pair has
    at most ``(1-t)/(1+t)`` of both sizes of them.
    """
    bits = sum((F.bit_count(F.col(f"m{i}_a").bitwiseXOR(F.col(f"m{i}_b"))) for i in range(lanes)), F.lit(0))
    sized = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9
    return sized & (bits <= (F.col("n_a") + F.col("n_b")) * ((1 - threshold) / (1 + threshold)) + 1e-6)


def _marked(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` that sizes and marks leave, with ``total``, the sum of their sizes."""
    left, right = (marks.select(*[F.col(c).alias(k if c == "k1" else f"{c}_{k}") for c in marks.columns]) for k in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").where(_near(threshold)).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"))


def _similar(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b, total)`` of lines whose exact Jaccard similarity reaches the threshold."""
    left, right = (texts.select(F.col("k1").alias(k), F.col("line").alias(f"line_{k}")) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect(_cuts(F.col("line_a")), _cuts(F.col("line_b"))))
    # common >= threshold * (total - common)
    return both.where(common * F.lit(1 + threshold) >= F.col("total") * F.lit(threshold) - 1e-9).select("a", "b")


def _maybe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ``k1`` may be among ``keys``: all that are, and those that share a slot of
    a bitmap with one. The bitmap goes to all tasks, 4 MB however many keys there are."""
    slot = F.shiftrightunsigned("k1", 64 - BITMAP_BITS) + 1  # these functions count from 1
    bits = keys.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col("bucket"))
    return held.where(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1).select(*rows.columns)


def _rarity(sets: DataFrame) -> Column:
    """How frequent shingles are, by the first ``SLOT_BITS`` bits of their hash: a binary
    value of that fixed size, which the driver makes, with three steps an octave, one byte a slot."""
    slots = sets.select(F.explode("g").alias("t")).groupBy(F.shiftrightunsigned("t", 64 - SLOT_BITS).cast("int").alias("slot")).agg(F.count("*").alias("c"))
    steps = bytearray(1 << SLOT_BITS)
    for row in slots.select("slot", F.floor(F.log2(F.col("c") + 1) * 3).cast("int").alias("step")).toLocalIterator():
        steps[row.slot] = row.step
    return F.lit(bytes(steps))


def _some(members: DataFrame, draws: int = 15) -> DataFrame:
    """``pivot, k1``: up to ``draws`` lines of each family, drawn by hash."""
    key = F.xxhash64("pivot", "draw")
    drawn = members.select("pivot", "k1", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    return drawn.groupBy("pivot", "draw").agg(F.min(F.col("k1").bitwiseXOR(key)).alias("least")).select("pivot", F.col("least").bitwiseXOR(key).alias("k1")).distinct()


def _middles(members: DataFrame, lines: DataFrame) -> DataFrame:
    """``pivot, g_p``: the shingles that most of some lines of a family have.

    ``members`` has ``k1, pivot``. Any set would do for ``_exact``; this one leaves the least
    differences, as a single line's own words would differ from all others.
    """
    drawn = _some(members)
    held = drawn.groupBy("pivot").agg(F.count("*").alias("drawn"))
    # Only the lines drawn are cut into shingles.
    shingles = drawn.join(lines.select("k1", "line"), "k1").select("pivot", F.explode(grams(F.col("line"))).alias("t"))
    counts = shingles.groupBy("pivot", "t").agg(F.count("*").alias("c"))
    return counts.join(held, "pivot").groupBy("pivot").agg(F.collect_list(F.when(F.col("c") * 2 > F.col("drawn"), F.col("t"))).alias("g_p"))


def _templates(members: DataFrame, pivots: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """``pivot`` of the families of ``members`` (``k1, pivot, m``, the latter their size) whose prefixes
    cost less than comparing all pairs of their marks, by the prefixes of some of their lines."""
    share = (1 - threshold) / (1 + threshold)
    tried = _some(members).join(pivots, "pivot").join(lines.select("k1", "n", grams(F.col("line")).alias("g")), "k1")
    x = F.size(F.array_except("g", "g_p")) + F.size(F.array_except("g_p", "g"))
    half = F.greatest(x + 1 - (x + F.col("n") * (threshold * (1 - share) - share) - F.size("g_p")) / 2, F.lit(1))
    cost = tried.groupBy("pivot").agg(F.avg(half).alias("half"))
    return members.select("pivot", "m").distinct().join(cost, "pivot").where(F.col("m") > F.col("half") * ROW).select("pivot")


def _crowded(members: DataFrame, lines: DataFrame, threshold: float, block: int) -> DataFrame:
    """All pairs ``(a, b)`` of different roots that reach the threshold, of lines that share a pivot;
    ``members`` has ``k1, pivot, m``, the latter the lines of a family.

    Families are joined block against block; wide marks drop nearly all other pairs within the
    join, so that a line moves once a block of its family, however many shingles it has.
    """
    marks = written(_marks(lines.join(members.select("k1").distinct(), "k1").select("k1", "line"), WIDE), "line-wide")
    rows = members.join(lines.select("k1", "root"), "k1").join(marks, "k1").withColumn("blocks", F.ceil(F.col("m") / F.lit(block)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int"))
    sent = ["k1", "root", *marks.columns[1:]]
    side = lambda k, p, q: rows.select("pivot", p.alias("p"), q.alias("q"), *[F.col(c).alias(f"{c}_{k}") for c in sent])
    left = side("a", F.col("own"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)))
    right = side("b", F.explode(F.sequence(F.lit(0), F.col("own"))), F.col("own"))
    met = left.join(right, ["pivot", "p", "q"]).where(F.expr("root_a <> root_b AND (p < q OR k1_a < k1_b)") & _near(threshold, WIDE))
    met = met.select(F.greatest("k1_a", "k1_b").alias("a"), F.least("k1_a", "k1_b").alias("b"), (F.col("n_a") + F.col("n_b")).alias("total"))
    return _similar(written(met.distinct(), "line-crowds"), lines, threshold)


def _exact(lines: DataFrame, families: DataFrame, threshold: float, block: int) -> DataFrame:
    """All pairs ``(a, b)`` of different roots that reach the threshold, of the lines that share a
    pivot and of the brief ones; ``lines`` has ``k1, root, line, brief`` and marks, ``families`` ``k1, pivot``.

    Families of up to ``block`` lines, and larger ones whose lines have too little in common for
    what follows to be cheaper (see ``_templates``), are compared pair by pair (see ``_crowded``).

    For the others and the brief lines: prefix filtering on what tells lines from the middle of
    a family (see ``_middles``): with ``x`` and ``y`` shingles that only one of ``a`` and the middle, of ``b`` and the middle has, a
    similar pair has at most ``d = r (n_a + n_b)``, ``r = (1-t)/(1+t)``, that only one of ``a`` and
    ``b`` has, so that at least ``(x + y - d)/2`` are in both differences. A line is ``x - r n``
    over; the pair is similar for certain if both together are not over zero, so all lines are
    linked with the nearest where that holds, and the others, the far ones, have some
    difference in common with any line that is similar. So what all lines of a family share, such
    as a template, makes none meet. Differences are in one order, rarest first. Where the
    partner is far, the first half or so must hold a common one; far lines are also looked up
    with what near partners ask for. Brief lines have the empty set as their middle.

    Any one order is right; this one asks a table of fixed size for the counts, so that
    shingles need not meet to be ordered. Sets that meet under a shingle are joined block against
    block; those of the root that most of them have are not joined with each other. Marks travel
    with the sets and drop most meetings before texts are compared.
    """
    marks = [f"m{i}" for i in range(LANES)]
    share = (1 - threshold) / (1 + threshold)
    # A family of one root is done.
    rooted = families.join(lines.select("k1", "root"), "k1").join(lines.select(F.col("k1").alias("pivot"), F.col("root").alias("own")), "pivot")
    split = rooted.groupBy("pivot").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("m")).where("least <> most").select("pivot", "m")
    # Written, so that their size is known.
    members = written(rooted.join(split, "pivot").select("k1", "pivot", "m", (F.col("root") == F.col("own")).alias("main")), "line-members")
    large = members.where(F.col("m") > block)
    pivots = written(_middles(large.where("main").select("pivot", "k1"), lines), "line-pivots")
    templates = written(_templates(large, pivots, lines, threshold), "line-templates")
    crowded = _crowded(members.join(templates, "pivot", "left_anti"), lines, threshold, block)
    kinds = members.select("k1", "pivot").join(pivots.join(templates, "pivot"), "pivot").join(lines.select("k1", "root", "n", *marks, grams(F.col("line")).alias("g")), "k1")
    # The pivot and the side are part of a shingle's hash.
    only = lambda one, other, side: F.transform(F.array_except(one, other), lambda t: F.xxhash64(t, "pivot", F.lit(side)))
    kinds = kinds.select("k1", "pivot", "root", "n", *marks, F.size("g_p").alias("n_p"), F.concat(only("g", "g_p", 0), only("g_p", "g", 1)).alias("g"))
    brief = lines.where("brief").select("k1", F.lit(0).cast("long").alias("pivot"), "root", "n", *marks, F.lit(0).alias("n_p"), grams(F.col("line")).alias("g"))
    sets = written(kinds.union(brief), "line-differences")
    rarity = _rarity(sets)
    step = lambda t: F.ascii(F.substring(rarity, F.shiftrightunsigned(t, 64 - SLOT_BITS).cast("int") + 1, F.lit(1)).cast("string"))
    key = lambda t: F.shiftleft(step(t).cast("long"), 48).bitwiseOR(t.bitwiseAND(F.lit((1 << 48) - 1)))
    n, n_p, x, over = F.col("n"), F.col("n_p"), F.col("x"), F.col("over")
    up = lambda c: F.greatest(F.ceil(c - 1e-9), F.lit(1)).cast("int")
    scored = sets.withColumn("x", F.size("g")).withColumn("over", x - n * share)
    nearest = scored.groupBy("pivot").agg(F.min(F.struct("over", "k1", "root")).alias("m")).select("pivot", F.col("m.over").alias("least"), F.col("m.k1").alias("nearest"), F.col("m.root").alias("main"))
    scored = scored.join(nearest, "pivot").withColumn("far", over + F.col("least") > 1e-9)
    sure = scored.where("NOT far AND k1 <> nearest").select(F.col("k1").alias("a"), F.col("nearest").alias("b"))
    ordered = scored.withColumn("root", F.when(F.col("far"), F.col("root")).otherwise(F.col("main"))).withColumns({
        # The least in common with a far partner, and of a far line with any.
        "half": x + 1 - up(F.greatest(over - F.col("least"), over + n * (threshold * (1 - share)) - n_p) / 2),
        "whole": x + 1 - up((over + F.col("least")) / 2),
    })
    named = ["k1", "pivot", "root", "n", *marks, "x", "far", "half"]
    rows = ordered.select(*named, F.posexplode(F.slice(F.sort_array(F.transform("g", key)), F.lit(1), F.greatest(F.col("half"), F.when(F.col("far"), F.col("whole")), F.lit(0)))).alias("i", "t"))
    # Three steps: it occurs once.
    rows = written(rows.where(F.shiftright("t", 48) > 3).withColumn("first", F.col("i") < F.col("half")), "line-prefixes")
    tokens = rows.groupBy("t", "root").agg(F.count("*").alias("m")).groupBy("t").agg(F.max_by("root", "m").alias("main"), F.sum("m").alias("m"), F.count("*").alias("roots"))
    rows = rows.join(tokens.where("roots > 1").select("t", "main", F.ceil(F.col("m") / F.lit(block)).cast("int").alias("blocks")), "t")
    own, every = F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = ["k1", "root", "n", "x", "i", "far", "first", *marks]
    # Side 1 joins sets of the main root with the others, side 0 the others with all.
    left = rows.where("first").select("t", own.alias("p"), every.alias("q"), (F.col("root") == F.col("main")).cast("int").alias("side"), *[F.col(c).alias(f"{c}_a") for c in sent])
    right = rows.where("far").select("*", F.explode(F.when(F.col("root") == F.col("main"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    right = right.select("t", "pivot", every.alias("p"), own.alias("q"), "side", *[F.col(c).alias(f"{c}_b") for c in sent])
    met = left.join(right, ["t", "p", "q", "side"]).where("root_a <> root_b AND (NOT far_a OR first_b AND k1_a < k1_b)")
    # What must be common, and what can be at most, with these places in the order.
    need = (F.col("x_a") + F.col("x_b") - (F.col("n_a") + F.col("n_b")) * share - 1e-9) / 2
    most = F.least("i_a", "i_b") + F.least(F.col("x_a") - F.col("i_a"), F.col("x_b") - F.col("i_b"))
    met = met.where(_near(threshold) & (most >= need))
    pairs = written(met.groupBy(F.greatest("k1_a", "k1_b").alias("a"), F.least("k1_a", "k1_b").alias("b"), "pivot").agg(F.count("*").alias("c")), "line-meetings")
    # The differences from one pivot tell the difference of two lines.
    one, other = (sets.select(F.col("k1").alias(k), "pivot", F.col("n").alias(f"n_{k}"), F.col("g").alias(f"g_{k}"), F.size("g").alias(f"x_{k}")) for k in ("a", "b"))
    both = pairs.select("a", "b", "pivot").join(one, ["a", "pivot"]).join(other, ["b", "pivot"])
    return both.where(F.size(F.array_intersect("g_a", "g_b")) >= need).select("a", "b").union(sure).union(crowded).distinct()


def duplicate_lines(docs: DataFrame, threshold: float = 0.8, keep: int = 9, small: int = 64, redraws: int = 3, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a line to remove: ``doc_id, line_no, kept_doc_id, kept_line_no, exact, text_hash``.

    A component holds the lines that are equal or linked by a Jaccard similarity of
    ``threshold`` or more of their 5-character shingles; its first line (by document,
    then position) stays and is named in the row. ``exact`` marks copies of a line of
    an earlier position. Lines without a word, null and empty texts and rows with a
    null id take no part. Rows that repeat an id are documents of their own, in the order of
    a hash of their texts, which ``text_hash`` names; equal rows are one document.

    Equal lines are combined before any shuffle. Each different line has up to
    ``2 * keep`` band keys. In bands of up to ``small`` lines all pairs meet. Larger ones are
    split by third minima into leaves; in leaves of up to ``LEAF`` lines all pairs meet, and the
    lines of larger ones are a family, paired with a pivot and ``redraws`` of its lines: linear,
    however large a band. Pairs whose sketches agree, and whose marks (see ``_marks``) allow it,
    are verified exactly; only their lines are fetched. Families, and lines of up to ``BRIEF``
    different shingles, are then compared by ``_exact`` wherever these links have not joined
    them. Lines are told apart by 128 bits of
    hash and linked by 64.
    """
    lines = lines_of(docs, id_col, text_col)
    sketched = sketches(lines.select("k1", "line"), keep).select("k1", F.struct("whole", "starts", _brief(F.col("line")).alias("brief")).alias("s"))
    sketched = written(sketched.groupBy("k1").agg(F.first("s").alias("s"), F.count("*").alias("places")).select("k1", "places", "s.*"), "line-sketches")
    # One exchange serves the counts and the join with them, as both ask for ``k1``.
    rows = sketched.select("k1", F.explode(bands()).alias("band")).repartition("band")
    counts = rows.groupBy("band").agg(F.count("k1").alias("n")).where("n > 1")
    held = written(rows.join(counts, "band").select("k1", "band", "n"), "line-bands")
    told = sketched.select("k1", "whole", "starts")
    leaves = written(_leaves(held, told, small), "line-leaves")
    families = written(_families(leaves, LEAF), "line-families")
    few = _pairs_in(leaves.where(F.col("n") <= LEAF).select("k1", "leaf"), "leaf")
    pairs = written(_met(held, told, small).union(few).union(_drawn(families, redraws)).distinct(), "line-pairs")
    # Lines that their bands leave open are compared in the end; each text is fetched once.
    open_ = families.select("k1").union(sketched.where("brief").select("k1")).withColumn("open", F.lit(True))
    paired = pairs.select(F.explode(F.array("a", "b")).alias("k1"), F.lit(False).alias("open"))
    # Written, so that its size is known: Spark broadcasts it if small, else joins by key.
    wanted = written(paired.union(open_).groupBy("k1").agg(F.max("open").alias("open")), "line-wanted")
    # Other texts stay where they are.
    texts = _maybe(lines.select("k1", "line"), wanted).join(wanted, "k1").groupBy("k1", "open").agg(F.min("line").alias("line"))
    texts = written(texts, "line-texts")
    marks = written(_marks(texts), "line-marks")
    close = written(_marked(pairs, marks, threshold), "line-close")
    groups = written(components(_similar(close, texts, threshold)), "line-groups")
    # Exactly, between the groups found so far.
    rest = texts.where("open").join(groups.withColumnRenamed("node", "k1"), "k1", "left").select("k1", F.coalesce("root", "k1").alias("root"), "line")
    rest = written(rest.join(marks, "k1").join(sketched.select("k1", "brief"), "k1"), "line-rest")
    near = written(_families(leaves, LEAF, groups), "line-nearest")
    more = written(_exact(rest, near, threshold, block), "line-links")
    groups = written(components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "line-components")

    # Lines of one place and no link stay; the others' places are looked up.
    again = written(sketched.where("places > 1").select("k1").union(groups.select("node")).distinct(), "line-again")
    seen = written(lines.select("doc_id", "text_hash", "line_no", "k1", "k2").join(again, "k1"), "line-places")
    seen = seen.withColumn("at", F.struct("doc_id", "text_hash", "line_no"))
    first = seen.groupBy("k1", "k2").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    first = first.join(groups.withColumnRenamed("node", "k1"), "k1", "left")
    roots = first.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("kept"))
    fate = first.join(roots, "root", "left").select("k1", "k2", "first", F.coalesce("kept", "first").alias("kept"), "n")
    # Only lines that lose a place are looked up.
    fate = fate.where("n > 1 OR kept < first").drop("n")
    gone = seen.join(fate, ["k1", "k2"]).where("at > kept")
    return gone.select(
        "doc_id", "line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"),
        (F.col("at") > F.col("first")).alias("exact"), "text_hash")


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without their duplicate lines; those left without a word are dropped.

    A row is judged by its own text: rows that repeat an id with another text are documents
    of their own, equal rows are one document and fare alike. Lines keep their order; rows
    that lose no line are unchanged, also if they are null or empty or have no id. All
    columns stay, as they are but for the text.
    """
    column = lambda c: F.col("`" + c.replace("`", "``") + "`")
    gone = written(duplicate_lines(docs, id_col=id_col, text_col=text_col, **options).select("doc_id", "text_hash", "line_no").distinct(), "gone-lines")
    gone = gone.groupBy("doc_id", "text_hash").agg(F.collect_list("line_no").alias("gone"))  # a document's own lines
    # All other columns are one, so that none of their names can clash.
    rows = docs.select(F.struct(*[column(c) for c in docs.columns if c != text_col]).alias("rest"), column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text")).join(gone, ["doc_id", "text_hash"], "left")
    rows = rows.withColumn("parts", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("parts", i)), "\n"))
    # As above: the generator makes each text once.
    rows = rows.select("rest", "gone", F.inline(F.array(F.struct(text.alias("left")))))
    rows = rows.where(F.col("gone").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*[F.col("left").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])
