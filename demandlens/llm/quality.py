"""Quality rules: base statistics and a hashed n-gram likelihood ratio, all in SQL functions.

Unigrams and bigrams of every text hash into `buckets`; two multinomials over
the buckets, of trusted documents and of the whole corpus, give each bucket the
weight ln(p_trusted / p_raw).  A document's score is the mean weight of its
n-grams (a last word pairs with the end), so length does not matter, and it is kept when the score is at least
`threshold`, the same for every document.  Few trusted words know few good
ones, so the threshold is lowered to what nearly all trusted documents reach
when each is scored without its own words.  The counts cover all documents, and
the trusted side and the threshold all trusted ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import WORD, materialise, n_words

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    """Words of a text as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def _settled(df: DataFrame) -> DataFrame:
    """df, whose columns filters above it take as they are.

    A filter that moved below the projections would repeat their expressions
    inside one another without end; no filter on what a generator makes does.
    """
    return df.select(F.inline(F.array(F.struct("*"))))


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and hw (word hashes).

    The hashes of three-word windows are sorted; places of those that occur
    twice are looked up where they are few, else found by sorting (hash, place)
    pairs.  A repeated place covers three words less its overlap with the next.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    out = docs.withColumn("_words", words(F.col("text")))
    out = out.withColumns({"hw": F.transform("_words", lambda w: F.xxhash64(w)), "_lines": lines, "word_chars": F.length(F.array_join("_words", "")).cast("long")}).drop("_words")
    hw, n = F.col("hw"), F.size("hw")
    out = out.withColumn("_h3", F.slice(F.transform("hw", lambda h, i: F.xxhash64(h, F.get(hw, i + 1), F.get(hw, i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0))))
    out = out.withColumn("_s", F.sort_array("_h3"))
    out = out.withColumn("_twice", F.array_distinct(F.filter("_s", lambda h, k: F.get("_s", k + 1).eqNullSafe(h))))
    few = F.size("_twice") <= 100
    pairs = F.sort_array(F.transform("_h3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_p", F.when(~few, pairs))
    place = F.transform("_h3", lambda h, i: F.when(F.array_contains("_twice", h), i))
    near = lambda p, k: F.coalesce(F.get("_p", k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get("_p", k + 1)["h"] == p["h"], F.lit(False))
    nowhere = F.expr("cast(array() as array<int>)")
    places = F.when(F.size("_twice") == 0, nowhere).when(few, F.array_compact(place)).otherwise(F.sort_array(F.transform(F.filter("_p", near), lambda p: p["i"])))
    out = out.withColumn("_at", places)
    covered = F.transform("_at", lambda x, k: F.coalesce(F.least(F.lit(3), F.get("_at", k + 1) - x), F.lit(3)))
    out = out.withColumns({
        "n_words": n.cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long"),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return _settled(out.drop("_lines", "_h3", "_s", "_twice", "_p", "_at"))


def _bucket(h: Column, buckets: int) -> Column:
    return (F.pmod(h, F.lit(buckets)) + 1).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids whose labels all say quality 1 and not toxic."""
    one = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return one.filter("q = 1 and t = 0").select("doc_id")


#: Bits of the sieve of trusted ids (4 MB whatever their number), and those of a row of it.
SIEVE, BLOCK = 1 << 25, 1 << 15


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text of every document with a trusted id.

    Ids may be too many for a broadcast.  A bitmap of their hashes is not, and
    leaves few other texts to the shuffle of the join, which decides.
    """
    ids = materialise(trusted_ids(labels), "trusted-ids")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE))
    place = [F.floor(at / BLOCK).alias("block"), F.pmod(at, F.lit(BLOCK)).alias("place")]
    sieve = ids.select(*place).repartition("block").groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("*", *place).join(F.broadcast(sieve), "block")
    rows = rows.filter("getbit(cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int), cast(place % 8 as int)) = 1")
    return materialise(rows.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text"), "trusted-texts")


#: The prior of the trusted multinomial is worth this share of the trusted n-grams, so weights have one scale at every size.
PRIOR = 1 / 16
#: Share of the trusted documents that may fall below the threshold when they are scored without their own words.
BELOW = 0.01
#: Words that a document must have; shorter ones fail the base rules and tell nothing of the score.
LEAST = 50


def _grams(rows: DataFrame, buckets: int, *keep: str) -> DataFrame:
    """keep and b, a row for each n-gram of the words w."""
    next_words = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    pair = rows.select(*keep, F.explode(F.arrays_zip(F.col("w").alias("a"), next_words.alias("b"))).alias("p"))
    a, b = F.xxhash64("p.a"), F.when(F.col("p.b").isNotNull(), F.xxhash64("p.b"))
    return pair.select(*keep, F.explode(F.array(_bucket(a, buckets), _bucket(F.xxhash64(a, b), buckets))).alias("b"))


def _weight(good: Column, raw: Column, g: Column, n: Column, prior: Column, buckets: int) -> Column:
    """ln(p_trusted / p_raw) in units of 1e-4; the raw multinomial is add-one, and the prior of the trusted one."""
    p = (raw + 1) / (n + buckets)
    return F.round(1e4 * F.ln((good + prior * p) / (g + prior) / p)).cast("int")


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """One row: raw and good, arrays of the n-grams of each bucket in docs and in trusted, and their sums n and g."""
    full = docs.sparkSession.range(1, buckets + 1, 1, 1).select(F.col("id").cast("int").alias("b"))
    for name, rows in (("raw", docs), ("good", trusted)):
        counts = _grams(rows.select(words(F.col("text")).alias("w")), buckets).groupBy("b").agg(F.count("*").alias(name))
        full = full.join(counts, "b", "left")
    full = full.select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    table = full.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "good"))).alias("t"), F.sum("raw").alias("n"), F.sum("good").alias("g"))
    return table.select(F.col("t")["raw"].alias("raw"), F.col("t")["good"].alias("good"), "n", "g")


def weights(counts: DataFrame, buckets: int) -> DataFrame:
    """counts and w: array of ln(p_trusted / p_raw) for each bucket, in units of 1e-4; 0 with no trusted documents."""
    each = F.zip_with("good", "raw", lambda x, y: _weight(x, y, F.col("g"), F.col("n"), _prior(F.col("g")), buckets))
    return counts.withColumn("w", each)


def _prior(g: Column) -> Column:
    return F.greatest(g * PRIOR, F.lit(1.0))


def held_out_scores(trusted: DataFrame, counts: DataFrame, sums: Row, buckets: int) -> DataFrame:
    """s: the score, in units of 1e-6, of each trusted document of LEAST words or more without its own words."""
    rows = trusted.filter(n_words(F.col("text")) >= LEAST).select(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hw"))
    grams = F.flatten(F.transform("hw", lambda h, i: F.array(_bucket(h, buckets), _bucket(F.xxhash64(h, F.get("hw", i + 1)), buckets))))
    rows = rows.select(F.sort_array(grams).alias("b"))
    rows = rows.withColumn("at", F.array_compact(F.transform("b", lambda x, k: F.when(~F.get("b", k - 1).eqNullSafe(x), k))))
    runs = F.transform("at", lambda x, k: F.struct(F.get("b", x).alias("b"), (F.coalesce(F.get("at", k + 1), F.size("b")) - x).alias("c")))
    rows = rows.select(runs.alias("runs"), F.size("b").alias("m"), *(counts.select(c).scalar().alias(c) for c in ("good", "raw")))
    g, n = F.lit(sums["g"]), F.lit(sums["n"])
    # As in quality_rules, the tables are subqueries' values, bound once by the outer function.
    term = lambda t, r: r["c"] * _weight(F.element_at(t["good"], r["b"]) - r["c"], F.element_at(t["raw"], r["b"]), g - F.col("m"), n, _prior(g), buckets)
    total = F.get(F.transform(F.array(F.struct("good", "raw")), lambda t: F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + term(t, r))), F.lit(0))
    return rows.select(F.round(total * 100 / F.col("m")).cast("long").alias("s"))


def held_out_level(trusted: DataFrame, counts: DataFrame, sums: Row, buckets: int) -> float | None:
    """The score that all but BELOW of the trusted documents reach without their own words; None without any.

    The two ranks beside that share are found among counts of thousandths, then
    of millionths in theirs, so no task sorts all scores.
    """
    scores = materialise(held_out_scores(trusted, counts, sums, buckets), "held-out")
    thousandth = F.floor(F.col("s") / 1000)
    tops = sorted(map(tuple, scores.groupBy(thousandth).count().collect()))
    if not tops:
        return None
    at = (sum(c for _, c in tops) - 1) * BELOW
    low, seen, start, among = int(at), 0, None, []
    for top, c in tops:
        if seen + c > low and seen <= low + 1:
            start = seen if start is None else start
            among.append(top)
        seen += c
    seen, near = start, []
    for s, c in sorted(map(tuple, scores.filter(thousandth.isin(among)).groupBy("s").count().collect())):
        near += [s] * len(range(max(seen, low), min(seen + c, low + 2)))
        seen += c
    return round((near[0] + (at - low) * (near[-1] - near[0])) / 1e6, 6)


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 15, threshold: float = -0.09) -> DataFrame:
    """docs with the base statistics, llr (mean weight of its n-grams, six decimals) and kept.

    Null texts have no words: llr 0, base_failed, not kept.  Labels may repeat
    or lack an id; an id counts as trusted only if all its labels agree.  Rows
    that repeat an id are judged each for itself, and all count as trusted if
    the id is.  Without trusted documents every score is 0 and the base rules
    decide.  Columns of docs that bear names given here are replaced.
    """
    trusted = trusted_texts(docs, labels)
    counts = materialise(weights(bucket_counts(docs, trusted, buckets), buckets), "counts")
    sums = counts.select("n", "g").first()
    if sums["g"]:
        level = held_out_level(trusted, counts, sums, buckets)
        threshold = threshold if level is None else min(threshold, level)
    out = base_statistics(docs).withColumn("_table", counts.select("w").scalar())
    # The table is a subquery's value, bound once by the outer function; as a literal it would fill the plan's text.
    weight = lambda t, h: F.element_at(t, _bucket(h, buckets))
    each = lambda t: F.transform("hw", lambda h, i: weight(t, h) + weight(t, F.xxhash64(h, F.get("hw", i + 1))))
    total = F.get(F.transform(F.array("_table"), lambda t: F.aggregate(each(t), F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)) / 1e4
    n = F.greatest(F.lit(1), 2 * F.size("hw"))
    out = out.withColumn("llr", F.round(total / n, 6))
    return _settled(out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop("hw", "_table"))
