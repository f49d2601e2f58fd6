"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and telephone numbers in whole texts.
They seed a bootstrap: every identifier-like token (eight or more characters, one of them a
digit) occurs in a lexical pattern, the word before it with the signs that lead up to it. In
the graph of patterns and distinct tokens, a pattern's score is the mean confidence of its
tokens (with a prior of one unsure token), a token's confidence is one if a base span covers
it, else the best score among its patterns; both are iterated. Patterns that end above a threshold,
with enough seeds, are accepted, and their tokens are found as further identifiers. Those are seeds of the
next hop, as sure as the pattern that found them, until a hop accepts no pattern: confidence
shrinks from hop to hop, which guards against drift.

Patterns and tokens are counted over all rows; the graph holds one row for each distinct pair,
so a token or pattern that fills a third of the rows is pre-aggregated to one.

Spark has no running sum over an array, and a character of a string is found by walking to it. So
running sums are taken in blocks of blocks, and long texts are cut into chunks that pieces are taken
from: a text with n matches takes some n^(4/3) steps, not n^2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stable

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive repeats match what the plain ones do, without deep recursion; the
#: look-behinds skip starts inside a run, which can only fail as the run's first did.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried at all.
HINTS = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9]",
}
#: An identifier-like token after a word and the signs that lead up to it.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{8,}+"
LEAD = r"([^\x20\x09-\x0D]{1,40}+[\x20\x09]*+[=:]?[\x20\x09]*+[\"']?)$"
#: Letters before a token that its pattern may reach into.
REACH = 48
THRESHOLD, SEEDS, ROUNDS = 0.7, 3, 3
#: Hops from pattern to pattern at most, by way of the tokens that they find.
HOPS = 10
#: Up to so many items a running sum is taken item by item.
FEW = 48


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + worth(i))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?(?:\.|$)){4}$")
    n = F.length(_digits(m))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.when((n >= 12) & (n <= 19), luhn(_digits(m))).otherwise(False)


def _bind(value: Column, then) -> Column:  # noqa: ANN001
    """``then(value)`` with the value computed once: what stands in a lambda is computed again for every item."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(sizes: Column, more, start: int) -> Column:  # noqa: ANN001
    """For an array of whole numbers, what ``more`` (sum or maximum) makes of the items before each. Items stand in blocks,
    and blocks in blocks, of the cube root of their number."""
    def all_of(a: Column) -> Column:
        return F.aggregate(a, F.lit(start), more)

    def before(a: Column, i: Column) -> Column:
        return all_of(F.slice(a, 1, i))

    def blocks(a: Column, b: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / b).cast("int")), lambda k: all_of(F.slice(a, k * b + 1, b)))

    def inside(a: Column, base: Column, b: Column) -> Column:
        """``base`` of the block, and the items before in it."""
        return F.transform(a, lambda _, i: more(F.get(base, F.floor(i / b).cast("int")), all_of(F.slice(a, i - i % b + 1, i % b))))

    def many(a: Column) -> Column:
        b = F.ceil(F.cbrt(F.size(a).cast("double"))).cast("int")
        return _bind(F.struct(blocks(a, b).alias("one"), b.alias("b")), lambda s: _bind(
            blocks(s["one"], s["b"]), lambda two: _bind(
                F.transform(two, lambda _, i: before(two, i)), lambda high: _bind(
                    inside(s["one"], high, s["b"]), lambda low: inside(a, low, s["b"])))))

    return _bind(sizes, lambda a: F.when(F.size(a) <= FEW, F.transform(a, lambda _, i: before(a, i))).otherwise(many(a)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _chunks(text: Column) -> Column:
    """(a text's chunks, their length): of some four times the square root of its length, 1024 at least."""
    n = F.greatest(F.lit(1024), F.ceil(4 * F.sqrt(F.length(text).cast("double"))).cast("int"))
    return _bind(F.struct(text.alias("t"), n.alias("n")), lambda s: F.struct(
        F.transform(F.sequence(F.lit(0), F.floor(F.length(s["t"]) / s["n"]).cast("int")), lambda k: F.substring(s["t"], k * s["n"] + 1, s["n"])).alias("c"), s["n"].alias("n")))


def _piece(chunks: Column, start: Column, end: Column) -> Column:
    """The characters [start, end) of a text in chunks."""
    first = F.floor(start / chunks["n"]).cast("int")
    held = F.array_join(F.slice(chunks["c"], first + 1, F.floor(end / chunks["n"]).cast("int") - first + 1), "")
    return F.substring(held, start - first * chunks["n"] + 1, end - start)


def _places(text: Column, pattern: str) -> Column:
    """(start, end, value) of all leftmost non-overlapping matches, in code points: the lengths of
    the pieces between matches and of the matches before one give its start."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)

    def placed(s: Column) -> Column:
        # a match and the piece before it, so what is before a match begins with its own piece
        sizes = F.transform(s["found"], lambda m, i: F.length(F.get(s["gaps"], i)) + F.length(m))
        at = _running(sizes, _sum, 0)
        return _bind(at, lambda before: F.transform(s["found"], lambda m, i: F.struct((F.get(before, i) + F.length(F.get(s["gaps"], i))).alias("start"), m.alias("value"))))

    spans = _bind(F.struct(found.alias("found"), gaps.alias("gaps")), placed)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), s["value"].alias("value")))


_SPANS = "array<struct<start:int,rank:int,end:int>>"


def base_spans(text: Column) -> Column:
    """Spans of the base kinds in a text: (start, rank of the kind, end), sorted."""
    def of(rank: int, kind: str) -> Column:
        good = F.filter(_places(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        spans = F.transform(good, lambda s: F.struct(s["start"].cast("int").alias("start"), F.lit(rank).alias("rank"), s["end"].cast("int").alias("end")))
        return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(_SPANS))

    return F.array_sort(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)]))


def _tokens(text: Column) -> Column:
    """Identifier-like tokens of a text: start, end, value and the lexical pattern before them."""
    def found(chunks: Column) -> Column:
        lead = lambda s: _piece(chunks, F.greatest(F.lit(0), s["start"] - REACH), s["start"])
        return F.transform(_places(text, TOKEN), lambda s: F.struct(
            s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["value"].alias("value"),
            F.lower(F.regexp_replace(F.regexp_extract(lead(s), LEAD, 1), r"[\x20\x09]+", " ")).alias("pattern")))

    return F.when(text.rlike(TOKEN), _bind(_chunks(text), found)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,pattern:string>>"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "id")])
    say = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(say, ",")


def _scored(known: DataFrame, rounds: int) -> DataFrame:
    """(pattern, score, seeds) of (pattern, value, sure): scores and the confidences of tokens that are not
    ``sure`` yet, iterated ``rounds`` times. seeds: a pattern's tokens that are sure enough."""
    def scored(conf: DataFrame) -> DataFrame:
        return conf.groupBy("pattern").agg((F.sum("conf") / (F.count(F.lit(1)) + 1)).alias("score"), F.sum((F.col("sure") >= THRESHOLD).cast("int")).alias("seeds"))

    conf = known.withColumn("conf", F.col("sure"))
    for _ in range(rounds - 1):
        strong = stable(scored(conf), "pii_patterns").filter(F.col("seeds") >= SEEDS).select("pattern", "score")
        best = known.join(strong, "pattern").groupBy("value").agg(F.max("score").alias("best"))
        conf = known.join(best, "value", "left").withColumn("conf", F.greatest("sure", F.coalesce("best", F.lit(0.0))))
    return scored(conf)


def pattern_scores(pairs: DataFrame, rounds: int = ROUNDS, hops: int = HOPS) -> DataFrame:
    """(pattern, score) of the accepted patterns, from (pattern, value, seed): the distinct pairs of the graph, seed
    1 if a base span covers the token. A hop accepts patterns; what they find is as sure as the best of them from
    the next hop on. It ends when a hop accepts none, ``hops`` hops at most."""
    accepted = None
    known = pairs.select("pattern", "value", F.col("seed").cast("double").alias("sure"))
    for _ in range(hops):
        good = _scored(known, rounds).filter((F.col("score") >= THRESHOLD) & (F.col("seeds") >= SEEDS)).select("pattern", "score")
        if accepted is not None:
            good = good.join(accepted.select("pattern"), "pattern", "left_anti")
        good = stable(good, "pii_accepted")
        if accepted is not None and good.isEmpty():
            break
        accepted = good if accepted is None else stable(accepted.union(good), "pii_accepted")
        found = pairs.join(accepted, "pattern").groupBy("value").agg(F.max("score").alias("found"))
        known = pairs.join(found, "value", "left").select("pattern", "value", F.greatest(F.col("seed").cast("double"), F.coalesce("found", F.lit(0.0))).alias("sure"))
    return accepted


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, extra): every row's base spans and the spans the bootstrap adds, as arrays
    of (start, rank of the kind, end), start and end in code points. Null texts are empty. key is
    a digest of the text: rows with equal texts have equal spans, whatever their ids."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.unhex(F.md5("text")).alias("key"), base_spans(F.col("text")).alias("base"), _tokens(F.col("text")).alias("tokens"))
    rows = stable(rows, "pii_rows")
    # each distinct text once; a token is covered if a base span that begins before its end ends after its start
    once = rows.filter(F.size("tokens") > 0).groupBy("key").agg(F.first("base").alias("base"), F.first("tokens").alias("tokens"))
    once = stable(once, "pii_texts")
    marks = once.select("key", F.explode("tokens").alias("t")).select("key", (F.col("t.end") - 1).alias("at"), F.lit(1).alias("ask"), F.col("t.end").alias("end"), "t")
    spans = once.select("key", F.explode("base").alias("b")).select("key", F.col("b.start").alias("at"), F.lit(0).alias("ask"), F.col("b.end").alias("end"), F.lit(None).cast(marks.schema["t"].dataType).alias("t"))
    upto = Window.partitionBy("key").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("ask") == 0, F.col("end"))).over(upto)
    said = marks.union(spans).withColumn("reach", reach).filter("ask = 1")
    said = said.select("key", "t", F.coalesce(F.col("reach") > F.col("t.start"), F.lit(False)).cast("int").alias("seed"))
    said = stable(said, "pii_tokens")
    pairs = said.filter("t.pattern <> ''").groupBy(F.col("t.pattern").alias("pattern"), F.col("t.value").alias("value")).agg(F.max("seed").alias("seed"))
    strong = pattern_scores(stable(pairs, "pii_pairs")).select("pattern")
    new = said.filter("seed = 0").select("key", F.col("t.pattern").alias("pattern"), "t").join(strong, "pattern", "left_semi")
    span = F.struct(F.col("t.start").alias("start"), F.lit(len(KINDS)).alias("rank"), F.col("t.end").alias("end"))
    extra = new.select("key", span.alias("span")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("span")).alias("extra"))
    return rows.select("doc_id", "key", "base").join(extra, "key", "left").withColumn("extra", F.coalesce("extra", F.array().cast(_SPANS)))


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the base kinds, the digest of the base spans and all spans."""
    found = extract(docs)
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select("doc_id", *[count(r).alias(f"n_{k}") for r, k in enumerate(KINDS)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(F.array_sort(F.concat("base", "extra"))).alias("spans"))


def _masked(text: Column, spans: Column) -> Column:
    """A text with its sorted spans replaced; spans that overlap are one, under the kind of the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "id")])

    def joined(s: Column) -> Column:
        ends = F.transform(s["spans"], lambda x: x["end"])
        reach = _running(ends, _larger, 0)  # where the spans before one end

        def pieces(reach: Column) -> Column:
            each = F.transform(s["spans"], lambda x, i: F.when(x["start"] >= F.get(reach, i), F.concat(_piece(s["chunks"], F.get(reach, i), x["start"]), F.get(names, x["rank"]))).otherwise(""))
            last = F.array_max(ends)
            return F.concat(F.array_join(each, ""), _piece(s["chunks"], last, F.greatest(last, s["size"])))

        return _bind(reach, pieces)

    return _bind(F.struct(_chunks(text).alias("chunks"), spans.alias("spans"), F.length(text).alias("size")), joined)


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that overlap are masked as
    one, under the kind of the first. n_chars, where there is such a column, is counted again.
    Null texts stay null; all other columns and rows stay as they are, whatever their names, and
    repeated rows stay repeated. An empty table gives no rows."""
    extra = extract(docs.filter("text is not null")).filter(F.size("base") + F.size("extra") > 0)
    spans = extra.select("key", F.array_sort(F.concat("base", "extra")).alias("spans")).dropDuplicates(["key"])
    packed = docs.select(F.struct("*").alias("row")).withColumn("key", F.unhex(F.md5(F.col("row.text").cast("string"))))
    text = F.col("row.text").cast("string")
    done = packed.join(spans, "key", "left").withColumn("text", F.when(F.col("spans").isNull(), text).otherwise(_masked(text, F.col("spans"))))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars")))
    return done.select(row.alias("row")).select("row.*")
