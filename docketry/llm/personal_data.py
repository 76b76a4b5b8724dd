"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Seeds are what the base patterns find: e-mail addresses, IP addresses, card and phone numbers. Every seed induces
lexical patterns from the words around it (the two words before it; the word before and the word
after it). Other identifier-like strings are unknown instances of the patterns they stand in: strings without white space
that hold a digit or an @, and runs of digit groups joined by spaces, dots, hyphens, brackets or colons. Spark scores the graph of patterns and instances in rounds: a pattern is as sure of a kind as the mean
belief of its instances, an instance as sure as one of its patterns being right. Unknown instances that end up
above `BELIEF`, in a pattern that `SUPPORT` different seeds induced, become spans of that kind.

One pass over the texts finds the spans and writes them with their surroundings, a small table; the graph is counted by
distinct value, so copies of a document lend no support, and is pre-aggregated by key.

Regular expressions are those of the contract, with possessive runs and look-behinds that only keep a failed attempt from being
repeated at every character of a long run: the matches are the same. A place's words are taken from the text since two matches before it to two after it, so a
word into which more matches run together counts from there. Positions and what overlaps are found in steps of bounded length, so a text costs what its length and its
matches cost.

Edge cases: null text is empty; an empty text has no spans; an empty table gives no rows; spans of different kinds may overlap;
repeated rows and ids are judged each; other columns are not read, and `mask` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.functions.given import given
from docketry.session import materialise

KINDS = ("email", "ip", "card", "phone")

# The base patterns, and a cheap sign without which a text has no match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9].)(?<![0-9][\x20-].)(?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

ROUNDS = 3
SUPPORT = 5
BELIEF = 0.8
UNKNOWN = r"(?<!\S)(?=\S*?[0-9@])\S++"
# Digit groups and what joins them, from a digit, a plus or a closed bracket to a digit.
GROUPS = r"(?<![^\s\x22'<{(\[])\+?+(?:\([0-9]++\)|[0-9])[0-9\x20.():\[\]-]*[0-9](?![\w@])"
# Elements of a step, as a power of two; code points of a bin, in which spans meet, and of a piece of text.
STEP = 6
BIN = 64
PIECE = 1024


def matches(text: str, pattern: str, sign: Column | None) -> Column:
    """Matches of a pattern in a text column, from left to right; none where the sign is missing."""
    hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    return F.when(sign, hits).otherwise(F.array().cast("array<string>")) if sign is not None else hits


def earlier(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's numbers what `combine` makes of 0 and all before it: steps as wholes, then within the step."""
    zero, step = F.lit(0), 1 << STEP

    def of_array(v: Column) -> Column:
        whole = F.transform(F.sequence(zero, F.shiftright(F.size(v) - 1, STEP)), lambda c: F.aggregate(F.slice(v, c * step + 1, step), zero, combine))
        bases = given(whole, lambda w: F.transform(w, lambda _, c: F.aggregate(F.slice(w, F.lit(1), c), zero, combine)))
        return given(bases, lambda b: F.transform(v, lambda _, i: F.aggregate(F.slice(v, F.shiftright(i, STEP) * step + 1, i % step), b[F.shiftright(i, STEP)], combine)))

    return given(values, lambda v: F.when(F.size(v) > 0, of_array(v)).otherwise(v))


def positions(hits: str, pieces: str) -> Column:
    """Matches with positions in code points and the patterns they stand in.

    The lengths of the matches and of the pieces between them, added up from the left, give the positions.
    """
    hit, piece = F.col(hits), F.col(pieces)
    said = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))

    def place(at: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            start = at[i] + F.char_length(piece[i])
            left = F.concat(said(piece, i - 2), said(hit, i - 2), said(piece, i - 1), said(hit, i - 1), piece[i])
            right = F.concat(said(piece, i + 1), said(hit, i + 1), said(piece, i + 2))
            return F.struct(start.alias("start"), (start + F.char_length(h)).alias("end"), h.alias("value"), contexts(left, right).alias("contexts"))

        return F.transform(hit, one)

    lengths = F.transform(hit, lambda h, i: F.char_length(piece[i]) + F.char_length(h))
    return given(earlier(lengths, lambda sum, x: sum + x), place)


def contexts(left: Column, right: Column) -> Column:
    """The lexical patterns of a place: two words before it; one before and one after."""
    word = lambda said, pattern, group: F.lower(F.nullif(F.regexp_extract(said, pattern, group), F.lit("")))
    two = F.regexp_replace(word(left, r"(?<!\S)\S++\s++\S++\s*+$", 0), r"\s+", " ")
    around = F.concat(F.lit("B "), word(left, r"(?<!\S)(\S++)\s*+$", 1), F.lit(" _ "), word(right, r"^\S*+\s++(\S++)", 1))
    return F.filter(F.array(F.concat(F.lit("L "), two), around), lambda c: c.isNotNull())


def passes(kind: str) -> str:
    """The condition on a match `s`."""
    digits = "regexp_replace(s.value, '[^0-9]', '')"
    if kind == "ip":
        return r"forall(split(s.value, '[.]'), part -> part RLIKE '^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')"
    if kind == "card":
        # From the right every second digit counts double, and nine is taken off what passes nine.
        digit = f"(ascii(substr(lpad({digits}, 20, '0'), i, 1)) - 48)"
        return f"aggregate(sequence(1, 20), 0, (sum, i) -> sum + if(i % 2 = 0, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}))) % 10 = 0"
    if kind == "phone":
        return f"char_length({digits}) BETWEEN 9 AND 15"
    return "true"


def base_spans(documents: DataFrame, text: str = "text") -> DataFrame:
    """All columns, with `base` (spans of the base patterns) and `others` (identifier-like strings and runs of digit groups)."""
    rows = documents.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    body = F.col("__text")
    for kind in KINDS:
        sign = body.contains(SIGNS[kind]) if SIGNS[kind] else None
        rows = rows.withColumn(f"__hit_{kind}", matches("__text", PATTERNS[kind], sign))
    rows = rows.withColumn("__hit_other", matches("__text", UNKNOWN, body.rlike("[0-9@]")))
    rows = rows.withColumn("__hit_groups", matches("__text", GROUPS, body.rlike("[0-9]")))
    for kind in (*KINDS, "other", "groups"):
        pattern = {"other": UNKNOWN, "groups": GROUPS, **PATTERNS}[kind]
        hits = F.col(f"__hit_{kind}")
        rows = rows.withColumn(f"__gap_{kind}", F.when(F.size(hits) > 0, F.split(body, pattern, -1)).otherwise(F.array().cast("array<string>")))
    for kind in (*KINDS, "other", "groups"):
        rows = rows.withColumn(f"__at_{kind}", positions(f"__hit_{kind}", f"__gap_{kind}"))
    parts = []
    for rank, kind in enumerate(KINDS):
        kept = f"filter(__at_{kind}, s -> {passes(kind)})"
        parts.append(f"transform({kept}, s -> struct(s.start AS start, {rank} AS rank, s.end AS end, s.value AS value, s.contexts AS contexts))")
    rows = rows.withColumn("base", F.expr(f"array_sort(concat({', '.join(parts)}))"))
    # Punctuation around an unknown string is not part of it.
    trimmed = r"""transform(__at_other, s -> struct(
        s.start + char_length(s.value) - char_length(regexp_replace(s.value, '^["\'(\\[<{]+', '')) AS start,
        s.end - char_length(s.value) + char_length(regexp_replace(s.value, '[^A-Za-z0-9]+$', '')) AS end,
        regexp_replace(regexp_replace(s.value, '^["\'(\\[<{]+', ''), '[^A-Za-z0-9]+$', '') AS value, s.contexts AS contexts))"""
    rows = rows.withColumn("__trimmed", F.expr(trimmed))
    rows = rows.withColumn("others", F.expr("filter(concat(__trimmed, __at_groups), o -> o.end > o.start)"))
    return rows.drop("__text", "__trimmed", *(f"__{part}_{kind}" for part in ("hit", "gap", "at") for kind in (*KINDS, "other", "groups")))


def bins(start: str, end: str) -> Column:
    """The bins that a span reaches into."""
    return F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor((F.col(end) - 1) / BIN)))


def untouched(unknown: DataFrame, base: DataFrame) -> DataFrame:
    """Rows of `unknown` (`uid`, `start`, `end`) that no span of `base` overlaps."""
    taken = base.select("uid", F.col("start").alias("from"), F.col("end").alias("to"), bins("start", "end").alias("bin"))
    near = unknown.select("uid", "start", "end", bins("start", "end").alias("bin")).join(taken, ["uid", "bin"])
    hit = near.where("from < end AND start < to").select("uid", "start", "end").distinct()
    return unknown.join(hit, ["uid", "start", "end"], "left_anti")


def outermost(spans: DataFrame) -> DataFrame:
    """Rows of `spans` (`uid`, `rank`, `start`, `end`) that lie in no longer one of their kind."""
    around = spans.select("uid", "rank", F.col("start").alias("from"), F.col("end").alias("to"), bins("start", "end").alias("bin"))
    near = spans.withColumn("bin", F.floor(F.col("start") / BIN)).join(around, ["uid", "rank", "bin"])
    inside = near.where("from <= start AND end <= to AND to - from > end - start").select("uid", "rank", "start", "end").distinct()
    return spans.join(inside, ["uid", "rank", "start", "end"], "left_anti")


def learned(spans: DataFrame, rounds: int, support: int, belief: float) -> DataFrame:
    """`pattern`, `value` and `rank` of the unknown instances that are believed to be of a kind.

    `spans` has one row per place: `value`, `rank` (null if unknown), `contexts`.
    """
    places = spans.select("value", "rank", F.explode("contexts").alias("pattern")).distinct()
    # Only patterns that enough different seeds of a kind induced can teach anything.
    taught = places.where("rank IS NOT NULL").groupBy("pattern", "rank").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= support)
    taught = materialise(taught.select("pattern", "rank"), "patterns")
    graph = materialise(places.join(taught.select("pattern").distinct(), "pattern", "left_semi"), "graph")
    sizes = graph.groupBy("pattern").agg(F.countDistinct("value").alias("n"))
    beliefs = graph.where("rank IS NOT NULL").select("value", "rank").distinct().withColumn("belief", F.lit(1.0))
    seeds = beliefs
    edges = graph.select("pattern", "value").distinct()
    for _ in range(rounds):
        sure = edges.join(beliefs, "value").groupBy("pattern", "rank").agg(F.sum("belief").alias("sum"))
        sure = sure.join(taught, ["pattern", "rank"]).join(sizes, "pattern").select("pattern", "rank", (F.col("sum") / F.col("n")).alias("sure"))
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("sure")))))
        scored = edges.join(sure, "pattern").groupBy("value", "rank").agg((1 - doubt).alias("belief"))
        beliefs = materialise(scored.join(seeds.select("value"), "value", "left_anti").unionByName(seeds), "beliefs")
    best = beliefs.where(F.col("belief") >= belief).groupBy("value").agg(F.max(F.struct("belief", (-F.col("rank")).alias("rank"))).alias("b"))
    found = best.select("value", (-F.col("b.rank")).alias("rank"))
    return graph.where("rank IS NULL").select("pattern", "value").join(taught, "pattern").join(found, ["value", "rank"]).select("value", "rank", "pattern").distinct()


def find(digest: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, belief: float = BELIEF) -> DataFrame:
    """Spans that the patterns add, by `uid`: `added`, an array of spans. `digest` has `uid`, `base` and `others`."""
    seeds = digest.select("uid", F.explode("base").alias("s")).select("uid", "s.start", "s.end", "s.value", "s.rank", "s.contexts")
    unknown = digest.select("uid", F.explode("others").alias("o")).select("uid", "o.start", "o.end", "o.value", "o.contexts")
    unknown = materialise(untouched(unknown, seeds), "unknown")
    spans = seeds.select("value", "rank", "contexts").unionByName(unknown.select("value", F.lit(None).cast("int").alias("rank"), "contexts"))
    believed = learned(spans, rounds, support, belief)
    places = unknown.select("uid", "start", "end", "value", F.explode("contexts").alias("pattern"))
    hits = places.join(believed, ["pattern", "value"]).select("uid", "rank", "start", "end").distinct()
    # A string within a run that is of the same kind adds nothing.
    hits = outermost(materialise(hits, "hits"))
    return hits.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("added"))


def joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"concat_ws(',', transform({spans}, s -> concat(array({names})[s.rank], ':', s.start, ':', s.end)))")


def personal_data(documents: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, belief: float = BELIEF) -> DataFrame:
    """Counts, digest and spans of every document."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = base_spans(texts).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "base", "others")
    digest = materialise(digest, "personal")
    added = find(digest, rounds, support, belief)
    rows = digest.join(added, "uid", "left").withColumn("basic", F.expr("transform(base, s -> struct(s.start AS start, s.rank AS rank, s.end AS end))"))
    rows = rows.withColumn("every", F.expr("array_sort(concat(basic, coalesce(added, slice(basic, 1, 0))))"))
    counts = [F.expr(f"cast(size(filter(basic, s -> s.rank = {i})) AS long)").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(joined("basic").cast("binary"), 256).alias("base_sha256"), joined("every").alias("spans"))


def mask(documents: DataFrame, text: str = "text", rounds: int = ROUNDS, support: int = SUPPORT, belief: float = BELIEF) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans give one mark, the first's."""
    columns = documents.columns
    held = F.struct(*[documents[f"`{c}`"].alias(c) for c in columns]).alias("__row")
    rows = base_spans(documents.select(held).select("__row", F.col(f"__row.`{text}`").alias("text"))).withColumn("uid", F.monotonically_increasing_id())
    rows = materialise(rows.select("uid", "__row", "base", "others"), "personal")
    added = find(rows, rounds, support, belief)
    rows = rows.join(added, "uid", "left")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    body = F.coalesce(F.col(f"__row.`{text}`").cast("string"), F.lit(""))
    spans = F.expr("array_sort(concat(transform(base, s -> struct(s.start AS start, s.rank AS rank, s.end AS end)), coalesce(added, array())))")
    # The end of what is covered before each span; a span that starts in it has no mark of its own.
    with_last = lambda s: F.concat(s, F.array(F.struct(F.char_length(body).alias("start"), F.lit(0).alias("rank"), F.char_length(body).alias("end"))))
    covered = lambda s: earlier(F.transform(s, lambda x: x["end"]), lambda most, x: F.greatest(most, x))

    def marked(pieces: Column, s: Column, upto: Column) -> Column:
        def between(low: Column, high: Column) -> Column:
            number = F.sequence(F.floor(low / PIECE).cast("int"), F.floor((high - 1) / PIECE).cast("int"))
            part = lambda c: F.substring(pieces[c], F.greatest(low - c * PIECE, F.lit(0)) + 1, high - F.greatest(low, c * PIECE))
            return F.when(high > low, F.array_join(F.transform(number, part), "")).otherwise("")

        last = F.size(s) - 1
        said = lambda x, i: F.when(x["start"] >= upto[i], F.concat(between(upto[i], x["start"]), F.when(i < last, names[x["rank"]]).otherwise(""))).otherwise("")
        return F.array_join(F.transform(s, said), "")

    pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    masked = given(pieces, lambda p: given(with_last(spans), lambda s: given(covered(s), lambda upto: marked(p, s, upto))))
    new = F.when((F.size("base") > 0) | F.col("added").isNotNull(), masked).otherwise(F.col(f"__row.`{text}`"))
    return rows.withColumn("__masked", new).select(*[F.col("__masked").alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in columns])


def q_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
