"""Personal data: fixed patterns, and bootstrapped contexts that find further identifiers.

DataFrame functions only. Spans of the fixed patterns are the seeds. Words beside them
are patterns; a pattern that stands beside enough seeds of one kind, and beside little
else, is trusted; identifier-like tokens beside trusted patterns become instances of the
kind and support further patterns in the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import bind
from docloom.scale import broadcast_if_small
from docloom.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Candidates: tokens with a digit or @, of so many characters and digits.
MIN_CHARS, MIN_DIGITS = 6, 3
#: A pattern is trusted with so many different instances (seeds, or found ones by their
#: score) that make up so large a part of all its instances; a token is found at a score.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_SCORE = 5.0, 0.6, 0.7
#: Characters of context on either side.
CONTEXT = 80

_SPACE = r"\x20\x09-\x0D"
# Each finds what the plain pattern finds from left to right. Possessive repetition and
# the look-behind keep the work linear: inside a run that failed no later start can match.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IN_TOKEN = "A-Za-z0-9@._%+/-"
_CANDIDATE = rf"(?<![{_IN_TOKEN}])[A-Za-z._%+/-]*+[0-9@][{_IN_TOKEN}]*+"


def _matches(text: Column, pattern: str) -> Column:
    """All matches as structs of ``start``, ``end`` (code points) and ``surface``: what
    lies between matches and the matches themselves, measured one after the other."""

    def measured(pieces: Column, found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int,surface:string>>)").alias("out"))

        def step(state: Column, x: Column) -> Column:
            begin = state["at"] + F.length(x["p"])
            end = begin + F.length(x["m"])
            span = F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("surface"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        zipped = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
        return F.aggregate(zipped, start, step, lambda s: s["out"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bind(F.split(text, pattern, -1), lambda pieces: bind(found, lambda f: measured(pieces, f)))


def _digits(surface: Column) -> Column:
    return F.regexp_replace(surface, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled; the digit sum is a multiple of ten."""
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10)).otherwise(c.cast("int")),
    )
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind: ``start``, ``rank`` of the kind, ``end``, ``surface``."""
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,surface:string>>)")
    only = lambda may, pattern: F.when(may, _matches(text, pattern)).otherwise(none)
    digit = text.rlike("[0-9]")
    kinds = [
        only(F.contains(text, F.lit("@")), _EMAIL),
        F.filter(only(digit, _IP), lambda s: s["surface"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        F.filter(
            only(digit, _CARD),
            lambda s: F.length(_digits(s["surface"])).between(12, 19) & _luhn(_digits(s["surface"])),
        ),
        F.filter(only(F.contains(text, F.lit("+")), _PHONE), lambda s: F.length(_digits(s["surface"])).between(9, 15)),
    ]

    def of_kind(rank: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["surface"].alias("surface"))

    ranked = [F.transform(spans, of_kind(rank)) for rank, spans in enumerate(kinds)]
    return F.when(digit | F.contains(text, F.lit("@")), F.array_sort(F.concat(*ranked))).otherwise(
        F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int,surface:string>>)")
    )


def candidates(text: Column, base: Column) -> Column:
    """Identifier-like tokens outside the base spans."""
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,surface:string>>)")
    # Without the points and signs at its end.
    cut = lambda s: F.struct(
        s["start"].alias("start"),
        (s["start"] + F.length(F.regexp_replace(s["surface"], "[._%+/-]++$", ""))).alias("end"),
        F.regexp_replace(s["surface"], "[._%+/-]++$", "").alias("surface"),
    )
    tokens = F.transform(F.when(text.rlike("[0-9@]"), _matches(text, _CANDIDATE)).otherwise(none), cut)
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    shaped = lambda s: (F.length(s["surface"]) >= MIN_CHARS) & (
        (F.length(_digits(s["surface"])) >= MIN_DIGITS) | s["surface"].rlike("[^@]@[^@]")
    )
    return F.filter(tokens, lambda s: shaped(s) & apart(s))


def _contexts(text: Column, span: Column) -> Column:
    """Patterns beside a span: one and two words before it, one word after it."""
    at = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before = F.lower(F.substring(text, at + 1, span["start"] - at))
    after = F.lower(F.substring(text, span["end"] + 1, F.lit(CONTEXT)))
    one = F.regexp_extract(before, rf"([^{_SPACE}]+)[{_SPACE}]*$", 1)
    two = F.regexp_replace(F.regexp_extract(before, rf"([^{_SPACE}]+[{_SPACE}]+[^{_SPACE}]+)[{_SPACE}]*$", 1), rf"[{_SPACE}]+", " ")
    follow = F.regexp_extract(after, rf"^[{_SPACE}]*([^{_SPACE}]+)", 1)
    said = F.array(F.concat(F.lit("before "), one), F.concat(F.lit("before "), two), F.concat(F.lit("after "), follow))
    return F.filter(said, lambda p: ~p.isin("before ", "after "))


def bootstrap(occurrences: DataFrame, rounds: int = 3) -> DataFrame:
    """``surface`` and ``rank`` of found instances, from ``surface``, ``rank`` (null: not
    known) and ``patterns`` of all occurrences."""
    edges = materialize(
        occurrences.select("surface", "rank", F.explode("patterns").alias("pattern")).groupBy("surface", "pattern")
        .agg(F.min("rank").alias("rank")),
        "edges",
    )
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("all")).filter(F.col("all") >= MIN_SUPPORT)
    totals = materialize(totals, "patterns")
    seeds = edges.filter("rank IS NOT NULL").select("surface", "rank").distinct().withColumn("score", F.lit(1.0))
    unknown = edges.filter("rank IS NULL").select("surface", "pattern").join(
        seeds.select("surface"), "surface", "left_anti"
    )
    unknown = materialize(unknown, "unknown")
    known, found = seeds, None
    for _ in range(rounds):
        support = edges.select("surface", "pattern").join(known, "surface").groupBy("pattern", "rank").agg(F.sum("score").alias("support"))
        trusted = (
            support.filter(F.col("support") >= MIN_SUPPORT).join(totals, "pattern")
            .withColumn("confidence", F.col("support") / (F.col("all") + 1)).filter(F.col("confidence") >= MIN_CONFIDENCE)
        )
        trusted = materialize(trusted, "trusted")
        # Evidence of several patterns adds up as that of independent witnesses.
        scored = unknown.join(broadcast_if_small(trusted), "pattern").groupBy("surface", "rank").agg(
            (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score")
        )
        best = Window.partitionBy("surface").orderBy(F.col("score").desc(), "rank")
        new = scored.filter(F.col("score") >= MIN_SCORE).withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")
        new = materialize(new, "found")
        grown = new.count() != (found.count() if found is not None else 0)
        found, known = new, seeds.unionByName(new)
        if not grown:
            break
    return found.select("surface", "rank")


def find(docs: DataFrame, rounds: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the number of base spans of each kind (``n_email`` ...), ``base_spans`` and
    ``spans`` for every document: ``kind:start:end`` by start, then kind, comma-joined,
    with code points and exclusive ends.

    ``base_spans`` are those of the fixed patterns. ``spans`` also has what contexts
    found, as ``email_like`` and so on. A null or empty text has no spans. Rows with
    equal keys and texts get equal results; rows with equal keys and other texts their
    own. No rows give no rows. Texts are read once and not shuffled.
    """
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    marked = docs.select(docs[key].alias("__key"), F.xxhash64(body).alias("__tie"), body.alias("text"))
    marked = marked.withColumn("base", base_spans(F.col("text"))).withColumn("tokens", candidates(F.col("text"), F.col("base")))
    said = lambda spans: F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["surface"].alias("surface"), _contexts(F.col("text"), s).alias("patterns"))
    )
    ranked = F.transform(
        "base", lambda s: F.struct(s["rank"].alias("rank"), s["surface"].alias("surface"), _contexts(F.col("text"), s).alias("patterns"))
    )
    marked = materialize(marked.select("__key", "__tie", "base", ranked.alias("seeds"), said("tokens").alias("tokens")), "marked")
    seeds = marked.select(F.explode("seeds").alias("s")).select("s.*")
    tokens = marked.select("__key", "__tie", F.explode("tokens").alias("t")).select("__key", "__tie", "t.*")
    found = bootstrap(
        seeds.select("surface", "rank", "patterns").unionByName(tokens.select("surface", F.lit(None).cast("int").alias("rank"), "patterns")), rounds
    )
    extra = tokens.select("__key", "__tie", "start", "end", "surface").distinct().join(found, "surface")
    extra = extra.groupBy("__key", "__tie").agg(
        F.collect_list(F.struct("start", (F.col("rank") + len(KINDS)).alias("rank"), "end")).alias("more")
    )
    rows, side = marked.alias("a"), extra.alias("b")
    joined = rows.join(side, F.expr("a.__key <=> b.__key AND a.__tie = b.__tie"), "left")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    both = F.array_sort(F.concat(plain, F.coalesce("more", F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int>>)"))))
    names = F.array(*[F.lit(k) for k in KINDS], *[F.lit(f"{k}_like") for k in KINDS])
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ","
    )
    return joined.select(
        F.col("a.__key").alias(key),
        *[count(rank).alias(f"n_{k}") for rank, k in enumerate(KINDS)],
        written(plain).alias("base_spans"), written(both).alias("spans"),
    )
