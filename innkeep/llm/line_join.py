"""Line dedup by an exact set-similarity join.

A line is the set of its words (ASCII letters lower-cased, `[^\\x20\\x09-\\x0D]+`,
as 64-bit hashes).  A line with words is removed when an earlier one (smaller
document id, then line number, then place) has a Jaccard similarity of
``num / den`` or more to it, be that line itself removed or not.  DataFrame
operations only:

1. words are counted in 2**20 buckets, a table of fixed size; a bucket's class
   of frequency and the word's hash make one global order, rare words first
   (any order is exact, this one makes short lists);
2. each line's words are put into that order; equal sets meet in one class,
   whose first line is its representative;
3. the first words of every set are posted; two sets meet at a posted word when
   sizes and the position of the word leave room for the needed overlap
   (prefix, length and positional filters) and the 128-bit parity signatures of
   the sets don't differ in more places than the sets may in words.  As one
   earlier match is enough, lists of frequent words (``LIST_CLASS``) first give
   each line one candidate: one line, first by place, then drawn, for each size
   of the lists of two of its words, rare ones first, in each round the next
   two.  The later line of a verified pair is done; this repeats while it pays,
   so a template's lines are compared with a few of them, not with each other;
4. lines still open join with all earlier lines, removed ones included, in all
   lists.  Sets that link share a number of prefix words that follows from their
   sizes; pairs that share fewer are dropped.  A line is verified against the
   candidate it shares most words with, then, if that one doesn't settle it,
   against the others, on whole sets that are read from the texts again.

Shuffle files and tables go as soon as the step that needs them has ended.

Edge cases: lines without words are never removed and match nothing; null text
has no lines; null ids come first; rows equal in id and text are one after the
other, line by line; a text's lines are split at line feeds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .storage import checked, cut, new_path, remove, staged as written

BUCKET_BITS = 20
CLASS_BITS = 8
LIST_CLASS = 10  # words in 32 lines or more
LIST_WORDS = 2  # words of a line looked at in a round
ROUNDS = 6
ROUND_PAYS = 20  # another round if this one has settled a twentieth of the lines left
SPACE = r"[\x20\x09-\x0D]+"


def _low(text: Column) -> Column:
    """A name of the text that is equal for texts equal up to the case of ASCII letters; white space stays as it is.

    Bytes above 127 are read as Latin-1, whose lower-casing moves lead bytes C0
    to DE up by 32.  The number of bytes that follow still tells these from
    others, so no two texts get one name; ASCII text is plainly lower-cased.
    """
    return F.lower(F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.decode(text.cast("binary"), "ISO-8859-1")))


def _odd(text: Column) -> Column:
    """Whether a text has white space other than spaces and line feeds."""
    return F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))


def _words(line: Column, odd: Column) -> Column:
    """Words of a lower-cased line, and empty strings between spaces (a plain split where spaces are all there is)."""
    return F.when(odd, F.split(line, SPACE)).otherwise(F.split(line, " "))


def _hashes(line: Column, odd: Column) -> Column:
    """Distinct word hashes of a lower-cased line."""
    return F.array_remove(F.array_distinct(F.transform(_words(line, odd), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")


def frequency_classes(texts: DataFrame) -> DataFrame:
    """One row, one array: the class of frequency (twice the binary logarithm) of each bucket."""
    flat = F.replace(_low(F.col("text")), F.lit("\n"), F.lit(" "))
    words = texts.select(F.explode(_words(flat, _odd(F.col("text")))).alias("w")).where("w != ''")
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).agg(F.count("*").alias("c"))
    every = texts.sparkSession.range(0, 1 << BUCKET_BITS, 1, 16).select(F.col("id").cast("int").alias("b"))
    cls = every.join(counts, "b", "left").select("b", F.coalesce(F.floor(2 * F.log2("c")), F.lit(0)).cast("int").alias("k"))
    parts = cls.groupBy(F.shiftright("b", 10).alias("g")).agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "k"))), lambda x: x.k).alias("ks"))
    return parts.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("g", "ks"))), lambda x: x.ks)).alias("classes"))


def _ordered(hashes: Column, classes: Column) -> Column:
    """The set in the global order: class of frequency in the high bits, the rest of the hash below."""
    low = (1 << (63 - CLASS_BITS)) - 1
    # without nulls in its type the array is sorted as plain longs
    return F.sort_array(F.transform(hashes, lambda h: F.coalesce(F.shiftleft(classes[_bucket(h)].cast("long"), 63 - CLASS_BITS), F.lit(0).cast("long")).bitwiseOR(h.bitwiseAND(low))))


def _parity(tokens: Column, half: int) -> Column:
    """64 of 128 bits, each the parity of the tokens that fall on it: sets differ in at least as many tokens as these differ in bits."""
    mine = lambda t: F.shiftright(t, 6).bitwiseAND(1).bitwiseXOR(1 - half)  # noqa: E731  1 for tokens of this half
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", mine(t), t.bitwiseAND(63).cast("int"))))


def marked_lines(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """``row, id, line, chars, removed`` for every line (``line`` null for rows without text).

    ``row`` numbers the rows of ``docs`` by place: it is read more than once and
    must give the same rows in the same places (a table does).
    """
    spark = docs.sparkSession
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    classes = written(frequency_classes(base.select("text")), f"{root}/frequencies")
    # nothing is computed from a whole text beside its lines: it would be copied to, and read again for, each of them
    each = base.select("row", "id", F.posexplode_outer(F.split("text", "\n")).alias("line", "s"))
    hashes = _hashes(_low(F.col("s")), _odd(F.col("s")))
    sets = each.select("row", "id", "line", F.char_length("s").alias("chars"), hashes.alias("hashes"))
    # the frequency array is one value for all rows: a scalar subquery, which the set's order refers to once
    sets = sets.select("*", F.coalesce(F.size("hashes"), F.lit(0)).alias("n"), classes.scalar().alias("classes"))
    sets = sets.select("row", "id", "line", "chars", "n", _ordered(F.col("hashes"), F.col("classes")).alias("t"))
    probe = F.expr(f"n - ceil({num} * n / {den}) + 1").cast("int")
    keyed = sets.select(
        F.monotonically_increasing_id().alias("node"), "row", "id", "line", "chars", "n", F.xxhash64("t").alias("k"), F.xxhash64(F.lit(1), "t").alias("k2"), _parity(F.col("t"), 0).alias("bits"), _parity(F.col("t"), 1).alias("bits2"), F.slice("t", F.lit(1), F.greatest(probe, F.lit(0))).alias("prefix")
    )
    keyed = written(keyed, f"{root}/keyed")

    # equal sets meet in one class, named by 128 bits of hash; its first line stands for it (a word of class 0 is in one line only)
    rare = F.filter("prefix", lambda t: t >= 1 << (63 - CLASS_BITS)).alias("rare")
    place = F.struct(F.coalesce("id", F.lit(-(1 << 63)).cast("long")).alias("id"), "line", "row")
    first = F.min(F.struct(place.alias("at"), "node", "n", "bits", "bits2", rare, F.size("prefix").alias("m")))
    reps = written(keyed.where("n > 0").groupBy("k", "k2").agg(first.alias("f")).select("f.*"), f"{root}/reps")
    lines = written(keyed.select("row", "id", "line", "chars", "n", "node"), f"{root}/lines")
    remove(spark, f"{root}/keyed")

    each_line = each.where("s is not null").select("row", "line", "s")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """``node`` of the later line of every pair ``node, to`` that links, by their whole sets, read from the texts again."""
        met = written(pairs, f"{root}/{name}-pairs")
        x, y = (reps.select(F.col("node").alias(c), F.col("at").alias(f"at_{k}")) for c, k in (("node", "x"), ("to", "y")))
        # short lists (counted) go to the large tables, longer ones meet them by a shuffle
        later = written(x.join(checked(met), "node"), f"{root}/{name}-later")
        remove(spark, f"{root}/{name}-pairs")
        pairs = written(y.join(checked(later), "to"), f"{root}/{name}-places")
        remove(spark, f"{root}/{name}-later")
        wanted = pairs.select("node", "at_x.row", "at_x.line").unionAll(pairs.select("to", "at_y.row", "at_y.line")).distinct()
        wanted = written(wanted, f"{root}/{name}-wanted")
        whole = each_line.join(checked(wanted), ["row", "line"]).select("node", _hashes(_low(F.col("s")), _odd(F.col("s"))).alias("t"))
        whole = written(whole, f"{root}/{name}-sets")
        both = pairs.join(whole.withColumnRenamed("t", "tx"), "node").join(whole.toDF("to", "ty"), "to")
        common = F.size(F.array_intersect("tx", "ty"))
        links = both.where(den * common >= num * (F.size("tx") + F.size("ty") - common))
        later = F.when(F.col("at_x") > F.col("at_y"), F.col("node")).otherwise(F.col("to"))
        links = written(links.select(later.alias("node")).distinct(), f"{root}/{name}-removed")
        for part in ("places", "wanted", "sets"):
            remove(spark, f"{root}/{name}-{part}")
        return links

    overlap = f"ceil({num} * (x.n + y.n) / {num + den})"
    #: the filters of a pair: sizes, places of the shared word, parities
    near = (
        f"{den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) and least(x.n - x.pos, y.n - y.pos) + least(x.pos, y.pos) >= {overlap}"
        f" and bit_count(x.bits ^ y.bits) + bit_count(x.bits2 ^ y.bits2) <= x.n + y.n - 2 * {overlap}"
    )
    packed = F.expr("shiftleft(cast(n as long), 32) | shiftleft(cast(pos as long), 1) | if(open, 1L, 0L)").alias("npo")

    def unpacked(condition: str) -> str:
        """``condition`` with n, pos and open of ``x`` and ``y`` taken from ``npo``."""
        parts = {"n": "cast(shiftright({}.npo, 32) as int)", "pos": "cast(shiftright({}.npo & 4294967295L, 1) as int)", "open": "({}.npo & 1L = 1L)"}
        return re.sub(r"\b([xy])\.(n|pos|open)\b", lambda m: parts[m[2]].format(m[1]), condition)

    def posts(of: DataFrame, *others: str, skip: Column = F.col("m") - F.size("rare")) -> DataFrame:
        """One row per word of ``rare``, whose first one has place ``skip`` in its line."""
        out = of.select("node", *others, "n", "bits", "bits2", F.posexplode("rare").alias("p", "tok"), skip.alias("skip"))
        return out.select("tok", "node", *others, "n", "bits", "bits2", F.expr("p + skip").alias("pos"))

    # 3. leaders of long lists, in rounds: an open line of a list is compared with its other ones, one candidate a line
    gone, still = None, reps.select("node", "n", "bits", "bits2", "rare", "m")
    long_lists = F.filter("rare", lambda t: t >= LIST_CLASS << (63 - CLASS_BITS))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int").alias("band")
    for r in range(ROUNDS):
        # the next few words of a line, rare ones first; the first line by place, then drawn ones
        some = still.withColumn("all", long_lists).withColumn("rare", F.slice("all", r * LIST_WORDS + 1, LIST_WORDS))
        here = posts(some, skip=F.col("m") - F.size("all") + r * LIST_WORDS).select("*", band)
        first = F.xxhash64("node", F.lit(r)) if r else F.col("node")
        lead = here.groupBy("tok", "band").agg(*[F.min_by(c, first).alias(c) for c in ("node", "n", "bits", "bits2", "pos")], F.count("*").alias("c")).where("c > 1")
        met = here.alias("x").join(lead.alias("y"), ["tok", "band"]).where(f"x.node != y.node and {near}")
        found = verified(met.groupBy("x.node").agg(F.min("y.node").alias("to")), f"round{r}")
        gone = found if gone is None else gone.unionAll(found)
        still = reps.select("node", "n", "bits", "bits2", "rare", "m").join(checked(gone), "node", "left_anti")
        if r and ROUND_PAYS * found.count() < still.count():
            break

    # 4. lines still open with all earlier ones; both sides have the same columns and no filter of their own, so one exchange serves them
    every = reps.join(checked(gone.select("node", F.lit(False).alias("open"))), "node", "left").select("*", F.col("at.id").alias("id"))
    every = posts(every.withColumn("open", F.coalesce("open", F.lit(True))), "id", "open").select("tok", "node", "id", "bits", "bits2", packed)
    # sets that link share all but n less the overlap of each one's prefix: in lines of 50 words some five of eleven
    met = every.alias("x").join(every.alias("y"), "tok").where(unpacked(f"if(x.open, x.id > y.id or (x.id = y.id and x.node != y.node), y.node is null and y.open) and {near}"))
    shared = F.expr(unpacked(f"{overlap} - ceil({num} * greatest(x.n, y.n) / {den}) + 1"))
    met = met.groupBy("x.node", F.col("y.node").alias("to")).agg(F.count("*").alias("c"), F.min(shared).alias("least")).where("c >= least")
    met = written(met.select("node", "to", "c"), f"{root}/rest-met")
    # one earlier match is enough: the line that shares most words first, the others of those that it doesn't settle
    best = verified(met.groupBy("node").agg(F.max_by("to", F.struct("c", "to")).alias("to")), "best")
    left = met.select("node", "to").join(checked(best), "node", "left_anti")
    gone = gone.unionAll(best).unionAll(verified(left, "rest")).distinct()

    # what stays of the lines with words: first lines of their classes without an earlier match
    stays = reps.select("node").join(checked(gone), "node", "left_anti").withColumn("stays", F.lit(True))
    out = lines.select("row", "id", "line", "chars", "n", "node").join(stays, "node", "left")
    return out.select("row", "id", "line", "chars", F.expr("n > 0 and stays is null").alias("removed"))


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """One row per input row: ``id_col, n_lines, n_removed, kept_chars`` (characters of the lines that stay)."""
    spark = docs.sparkSession
    root = new_path(spark, "line-join")
    lines = marked_lines(docs, root, id_col, text_col, num, den)
    out = lines.groupBy("row", "id").agg(
        F.count("line").alias("n_lines"), F.count_if("removed").alias("n_removed"), F.coalesce(F.sum(F.when(~F.col("removed"), F.col("chars"))), F.lit(0)).cast("long").alias("kept_chars")
    )
    out = cut(out.select(F.col("id").alias(id_col), "n_lines", "n_removed", "kept_chars"))
    remove(spark, root)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` with removed lines taken out of ``text_col``."""
    spark = docs.sparkSession
    root = new_path(spark, "line-join")
    lost = marked_lines(docs, root, id_col, text_col, num, den).where("removed").groupBy(F.col("row").alias("line_row")).agg(F.collect_list("line").alias("line_lost"))
    lost = cut(lost)
    remove(spark, root)
    placed = docs.select(F.struct(*docs.columns).alias("r"), F.monotonically_increasing_id().alias("line_row")).join(lost, "line_row", "left")
    own = F.col("r").getField(text_col)
    lines = F.split(own, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("line_lost"))
    text = F.when(F.col("line_lost").isNull(), own).otherwise(F.array_join(F.transform(kept, lambda i: lines[i]), "\n"))
    return placed.select(*[text.alias(c) if c == text_col else F.col("r").getField(c).alias(c) for c in docs.columns])
