"""Line deduplication by an exact set-similarity join, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import bind
from docloom.scale import fits_broadcast
from docloom.session import materialize

#: Smallest Jaccard similarity of two lines' token sets, as a fraction.
SIMILARITY = (4, 5)
#: Token counts are kept for classes of tokens by hash: a table of fixed size.
CLASSES = 1 << 19
#: Ids of lines are sent to all executors up to so many.
ACTIVE_ROWS = 500_000
#: Lines of more tokens have 128 parity bits.
LONG_LINE = 60
_NULL_KEY = (1 << 63) - 1


def spaced(text: Column) -> Column:
    """The text with a space for all white space but line ends."""
    other = "[\\x09\\x0B-\\x0D]"
    return F.when(text.rlike(other), F.regexp_replace(text, other, " ")).otherwise(text)


def tokens(line: Column) -> Column:
    """The words of a spaced line, with empty strings where a space follows a space."""
    return F.split(line, " ")


def rarity(lines: DataFrame) -> Column:
    """One row's array of a number for each token class: the logarithm of its count, in the top byte."""
    words = lines.select(F.explode(tokens(F.col("line"))).alias("t"))
    counts = words.groupBy(F.xxhash64("t").bitwiseAND(F.lit(CLASSES - 1)).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    every = lines.sparkSession.range(0, CLASSES, 1, 8).withColumnRenamed("id", "class")
    level = F.least(F.lit(127), F.floor(3 * F.log2(F.coalesce("n", F.lit(1))))).cast("long")
    # CLASSES rows, whatever the input.
    dense = every.join(counts, "class", "left").select(F.struct("class", F.shiftleft(level, 56).alias("level")).alias("x"))
    table = materialize(dense.agg(F.sort_array(F.collect_list("x"))["level"].alias("levels")), "rarity")
    return table.scalar()


def token_keys(lines: DataFrame, levels: Column) -> DataFrame:
    """Adds ``keys``: the line's distinct tokens as numbers, the rarest first. A key has
    the token's rarity in the top byte and 56 bits of its hash."""
    hashes = F.array_remove(F.array_distinct(F.transform(tokens(F.col("line")), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))
    # Arrays that can't hold nulls are sorted as plain numbers.
    level = lambda h: F.coalesce(F.get(F.col("__levels"), h.bitwiseAND(F.lit(CLASSES - 1)).cast("int")), F.lit(0).cast("long"))
    key = lambda h: level(h).bitwiseOR(F.shiftrightunsigned(h, 8))
    return lines.withColumn("__levels", levels).withColumn("keys", F.sort_array(F.transform(hashes, key))).drop("__levels")


class Bounds:
    """What a similarity of a/b or more asks of two sets of n and m tokens."""

    def __init__(self, similarity: tuple[int, int]):
        self.a, self.b = similarity

    def prefix(self, n: str) -> str:
        """So many of the rarest tokens that similar sets share one of them."""
        return f"({n} - ({self.a} * {n} + {self.b - 1}) div {self.b} + 1)"

    def overlap(self, n: str, m: str) -> str:
        return f"(({self.a} * ({n} + {m}) + {self.a + self.b - 1}) div {self.a + self.b})"

    def smallest(self) -> int:
        """Smaller sets have no similar set but themselves."""
        return -(-self.a // (self.b - self.a))

    def possible(self, x: str, y: str) -> Column:
        """Length filter; positional filter on a shared token; and a filter on parity bits:
        sets that differ in d tokens differ in d bits at most."""
        n, m = f"{x}.n", f"{y}.n"
        need = self.overlap(n, m)
        return F.expr(
            f"{m} * {self.b} >= {n} * {self.a} AND {n} * {self.b} >= {m} * {self.a}"
            f" AND least({x}.pos, {y}.pos) + least({n} - {x}.pos, {m} - {y}.pos) >= {need}"
            f" AND (CASE WHEN {x}.upper IS NULL OR {y}.upper IS NULL THEN bit_count({x}.parity ^ {y}.parity)"
            f" ELSE bit_count({x}.upper ^ {y}.upper) + bit_count({x}.parity ^ {x}.upper ^ {y}.parity ^ {y}.upper) END)"
            f" <= {n} + {m} - 2 * {need}"
        )


def similar_lines(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The lines (``doc``, ``line_no``) to remove from ``docs`` (``doc``, ``text``). ``doc``
    may be of any type with an order; no two rows have the same."""
    bounds = Bounds(similarity)
    lines = docs.select("doc", F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("line_no", "line"))
    # Lines without words have no keys; a filter on the keys would have them computed twice.
    lines = lines.filter("trim(line) <> ''")
    # Words are the same in the whole text as in its lines.
    levels = rarity(docs.select(F.replace(spaced(F.col("text")), F.lit("\n"), F.lit(" ")).alias("line")))
    keyed = token_keys(lines, levels).withColumn("n", F.size("keys"))
    # 64 parity bits of the tokens; for long lines those of half of them too, which makes 128.
    one_bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))
    bits_of = lambda keys: F.aggregate(keys, F.lit(0).cast("long"), lambda bits, k: bits.bitwiseXOR(one_bit(k)))
    half = F.filter("keys", lambda k: k.bitwiseAND(F.lit(64)) != 0)
    sets = keyed.select(
        F.xxhash64("keys").alias("s1"), F.xxhash64(F.lit(1), "keys").alias("s2"), "doc", "line_no", "n",
        F.when(F.col("n") >= bounds.smallest(), bits_of(F.col("keys"))).alias("parity"),
        F.when(F.col("n") > LONG_LINE, bits_of(half)).alias("upper"),
        F.when(F.col("n") >= bounds.smallest(), F.slice("keys", F.lit(1), F.expr(f"int{bounds.prefix('n')}"))).alias("prefix"),
    )
    sets = materialize(sets, "sets")
    first = F.struct("doc", "line_no")
    firsts = sets.groupBy("s1", "s2").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"))
    several = materialize(firsts.filter("copies > 1").select("s1", "s2", "first"), "copies")
    # A line with the same tokens as an earlier one goes; the first of each set is compared.
    marked = sets.join(several, ["s1", "s2"], "left").withColumn("again", F.coalesce(first > F.col("first"), F.lit(False)))
    copies = marked.filter("again").select("doc", "line_no")
    rows = marked.filter("NOT again AND prefix IS NOT NULL").select(
        "doc", "line_no", "n", "parity", "upper", F.posexplode("prefix").alias("pos", "token")
    ).filter(F.shiftrightunsigned("token", 56) > 0)  # Level 0: a token of one line only.
    same = "x.token = y.token AND NOT (x.doc = y.doc AND x.line_no = y.line_no)"
    met = rows.alias("x").join(rows.alias("y"), F.expr(same) & bounds.possible("x", "y"), "left_semi")
    met = materialize(met, "met")
    # First with one of the lines that lead a token and length class; a large group of
    # variants ends here.
    classed = met.withColumn("class", F.floor(F.log("n") / F.log(F.lit(similarity[1] / similarity[0]))))
    leaders = classed.groupBy("token", "class").agg(
        F.min(F.struct("doc", "line_no", "n", "parity", "upper", "pos")).alias("y"), F.count(F.lit(1)).alias("k")
    ).filter("k > 1").select("token", "class", "y.*")
    earlier = "(y.doc < x.doc OR y.doc = x.doc AND y.line_no < x.line_no)"
    led = classed.alias("x").join(
        leaders.alias("y"), F.expr("x.token = y.token AND x.class = y.class AND " + earlier) & bounds.possible("x", "y")
    )
    active = materialize(met.select("doc", "line_no").distinct(), "active")
    # Only these lines of a text are taken apart again.
    numbers = active.groupBy("doc").agg(F.collect_list("line_no").alias("numbers"))
    numbered = docs.join(F.broadcast(numbers) if fits_broadcast(active, max_rows=ACTIVE_ROWS) else numbers, "doc")
    line_at = lambda every: F.transform("numbers", lambda i: F.struct(i.alias("line_no"), F.get(every, i).alias("line")))
    bodies = numbered.select("doc", F.inline(bind(F.split(spaced(F.col("text")), "\n"), line_at)))
    bodies = materialize(token_keys(bodies, levels).select("doc", "line_no", "keys"), "bodies")
    gone = materialize(_verified(_likeliest(led), bodies, similarity), "led")
    # The lines that are left are met with every earlier one, as semi joins: a line stops at the
    # first that is similar, and no pair becomes a row. Keys go only to lines that pass the filters.
    waiting = met.join(gone, ["doc", "line_no"], "left_anti")
    pair = F.expr("x.token = y.token AND " + earlier) & bounds.possible("x", "y")
    later = materialize(waiting.alias("x").join(met.alias("y"), pair, "left_semi"), "later")
    before = met.alias("y").join(later.alias("x"), pair, "left_semi")
    x, y = (side.join(bodies, ["doc", "line_no"]).alias(name) for side, name in ((later, "x"), (before, "y")))
    more = x.join(y, pair & _similar("x.keys", "y.keys", similarity), "left_semi").select("doc", "line_no").distinct()
    return reduce(lambda a, b: a.unionByName(b), [copies, gone, more])


def _similar(x: str, y: str, similarity: tuple[int, int]) -> Column:
    a, b = similarity
    return F.size(F.array_intersect(x, y)) * (a + b) >= (F.size(x) + F.size(y)) * a


def _likeliest(pairs: DataFrame) -> DataFrame:
    """For each line x the y that differs from it in the fewest parity bits, then the earliest."""
    bits = F.bit_count(F.col("x.parity").bitwiseXOR(F.col("y.parity"))).alias("bits")
    best = pairs.groupBy(F.col("x.doc").alias("x_doc"), F.col("x.line_no").alias("x_line_no")).agg(
        F.min(F.struct(bits, F.col("y.doc").alias("y_doc"), F.col("y.line_no").alias("y_line_no"))).alias("y")
    )
    return best.select("x_doc", "x_line_no", "y.y_doc", "y.y_line_no")


def _verified(pairs: DataFrame, bodies: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The lines x that are similar to one of their y."""
    side = lambda s: bodies.select(*[F.col(c).alias(f"{s}_{c}") for c in ("doc", "line_no", "keys")])
    both = pairs.join(side("x"), ["x_doc", "x_line_no"]).join(side("y"), ["y_doc", "y_line_no"])
    good = both.filter(_similar("x_keys", "y_keys", similarity))
    return good.select(F.col("x_doc").alias("doc"), F.col("x_line_no").alias("line_no")).distinct()


def dedup_lines(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, with_text: bool = True, text: str = "text", key: str = "doc_id",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the ``carry`` columns, ``n_lines``, ``n_removed``, ``removed`` (line numbers from 0, ascending) and
    (if asked for) ``kept_text``: every document without the lines that come later than
    a similar one.

    A line's tokens are its words, as a set. It goes if a line of an earlier document, or
    an earlier line of its own, has a Jaccard similarity of at least ``similarity``; lines
    are judged on the input. Documents are ordered by key, null keys last, and those with
    equal keys by a digest of their texts; rows with the same key and text are one document
    and lose the same lines. Lines without words stay. A null text has no lines. No rows
    give no rows. Tokens are compared by 56 bits of hash.
    """
    rows = docs.select(
        docs[key].alias("__id"), F.coalesce(docs[key].cast("long"), F.lit(_NULL_KEY)).alias("doc"),
        docs[text].cast("string").alias("text"), *[docs[c].alias(f"__{i}") for i, c in enumerate(carry)],
    )
    texts = rows.select("doc", "text")
    if not rows.groupBy("doc").count().filter("count > 1").isEmpty():
        # Keys alone do not tell rows apart. Where they do, digests would not change the order.
        digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
        rows = rows.withColumn("doc", F.struct(F.col("doc").alias("key"), digest.alias("tid")))
        texts = rows.select("doc", "text").filter("text IS NOT NULL").dropDuplicates(["doc"])
    gone = similar_lines(texts, similarity).groupBy("doc").agg(
        F.array_sort(F.collect_set("line_no")).alias("removed")
    )
    counted = rows.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))))
    none = F.array().cast("array<int>")
    out = counted if with_text else counted.drop("text")
    out = out.join(gone, "doc", "left").withColumn("removed", F.coalesce("removed", none))
    columns = [F.col("__id").alias(key), *[F.col(f"__{i}").alias(c) for i, c in enumerate(carry)], F.col("n_lines").cast("long"), F.size("removed").cast("long").alias("n_removed"), "removed"]
    if with_text:
        # Removed line numbers ascend, so the lines between two of them stay together.
        lines = F.split("text", "\n")
        kept = F.when(F.size("removed") == 0, F.col("text")).otherwise(
            F.array_join(F.filter(F.transform(lines, lambda line, i: F.when(~F.array_contains("removed", i), line)), lambda x: x.isNotNull()), "\n")
        )
        columns.append(kept.alias("kept_text"))
    return out.select(*columns)
