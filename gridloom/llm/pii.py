"""Personal data by bootstrapped contextual extraction, on SQL functions only.

Base entities (email, ip, card, phone) come from patterns. They are the seeds: the
words around a seed induce lexical patterns, every identifier-like token of the corpus
is an instance of the patterns around it, and Spark scores the pattern-instance graph in
a few rounds. Patterns that hold mostly known instances are trusted, instances that
trusted patterns hold become known and may raise further patterns. Unseen identifiers
that end up known are returned as spans of the kind `id`, beside the base spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut

# Fixed patterns. Possessive quantifiers match what greedy ones would and don't
# backtrack; (?:\\G|(?<!..)) starts a match only where a longer one can't, so that a
# run of characters is scanned once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
# An identifier-like token: six or more of these characters, one of them a digit.
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{6})(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]++"

MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.8
WHITE = r"\x20\x09-\x0D"


def _spans(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    """Pieces, matches and, from the columns _gaps and _hits, the array<struct<start, end, value, before, after>> in code points.

    The pieces between matches and the matches alternate, so running lengths give places.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as {kind})").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        value = F.get(F.col("_hits"), i)
        start = acc["at"] + F.char_length(F.get(F.col("_gaps"), i))
        end = start + F.char_length(value)
        # the last two words before and the first word after, of any length; read backwards to start at the match
        before = F.reverse(F.regexp_extract(F.reverse(F.get(F.col("_gaps"), i)), f"^[{WHITE}]*+[^{WHITE}]*+[{WHITE}]*+[^{WHITE}]*+", 0))
        after = F.regexp_extract(F.get(F.col("_gaps"), i + 1), f"^[{WHITE}]*+[^{WHITE}]*+", 0)
        row = F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), value.alias("value"), before.alias("before"), after.alias("after"))
        return F.struct(end.cast("bigint").alias("at"), F.array_append(acc["out"], row).alias("out"))

    folded = F.aggregate(F.sequence(F.lit(0), F.size("_hits") - 1), begin, step, lambda acc: acc["out"])
    return gaps, hits, F.when(F.size("_hits") > 0, folded).otherwise(F.expr(f"cast(array() as {kind})"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octet(part: Column) -> Column:
    short = F.ltrim(part, F.lit("0"))
    return (F.char_length(short) <= 3) & (F.concat(F.lit("0"), F.left(short, F.lit(3))).cast("int") <= 255)


def _valid(kind: str, span: Column) -> Column:
    digits = _digits(span["value"])
    if kind == "ip":
        return F.forall(F.split(span["value"], r"\."), _octet)
    if kind == "card":
        return F.char_length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def _scanned(docs: DataFrame, kind: str, pattern: str, may: Column) -> DataFrame:
    """docs with a column named kind of valid spans; texts where may is false aren't scanned."""
    text = F.when(may, F.col("text")).otherwise("")
    gaps, hits, spans = _spans(text, pattern)
    return docs.withColumn("_gaps", gaps).withColumn("_hits", hits).withColumn(kind, F.filter(spans, lambda s: _valid(kind, s))).drop("_gaps", "_hits")


def base_entities(docs: DataFrame) -> DataFrame:
    """docs' doc_id, uid and text with an array of valid spans per base kind."""
    has_digit = F.col("text").rlike("[0-9]")
    out = _scanned(docs, "email", EMAIL, F.contains("text", F.lit("@")))
    out = _scanned(out, "ip", IP, F.col("text").rlike(r"[0-9]\.[0-9]"))
    out = _scanned(out, "card", CARD, F.col("text").rlike(r"[0-9](?:[\x20-]?[0-9]){11}"))
    out = _scanned(out, "phone", PHONE, F.col("text").rlike(r"\+[0-9]"))
    out = _scanned(out.withColumn("_digit", has_digit), "token", TOKEN, F.col("_digit"))
    return out.drop("_digit")


def _context(before: Column, after: Column) -> Column:
    """Lexical patterns around a place: left word, left two words, left and right word."""
    word = lambda c, i: F.lower(F.coalesce(F.try_element_at(F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(i)), F.lit("")))
    l1, l2, r1 = word(before, -1), word(before, -2), word(after, 1)
    named = F.array(
        F.when(l1 != "", F.concat(F.lit("l:"), l1)),
        F.when((l1 != "") & (l2 != ""), F.concat(F.lit("ll:"), l2, F.lit(" "), l1)),
        F.when((l1 != "") & (r1 != ""), F.concat(F.lit("lr:"), l1, F.lit(" _ "), r1)),
    )
    return F.array_compact(named)


def _instances(found: DataFrame) -> DataFrame:
    """One row per seed and per identifier-like token outside base spans: uid, span, value, known, patterns."""
    base = F.concat(*[F.col(k) for k in KINDS])
    clear = F.filter("token", lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    mark = lambda spans, known: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(known).alias("known"), _context(s["before"], s["after"]).alias("patterns")))
    both = F.concat(mark(base, True), mark(clear, False))
    return found.filter(F.size(base) + F.size("token") > 0).select("uid", F.explode(both).alias("i")).select("uid", "i.*")


def discovered(found: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """uid, start, end of identifiers that trusted patterns reveal.

    A pattern is trusted with min_support different known values and min_confidence as
    the share of known among all its different values. A value is known if it is a seed
    or stands in a trusted pattern. All scores are aggregates over the whole graph; rounds
    go on until they reveal no new value.
    """
    graph = cut(_instances(found))
    links = graph.select("value", F.explode("patterns").alias("pattern")).groupBy("value", "pattern").agg(F.lit(1).alias("one")).drop("one")
    links = cut(links)
    known = cut(graph.filter("known").select("value").distinct())
    before, count = -1, known.count()
    while count > before:
        marked = links.join(known.withColumn("is_known", F.lit(1)), "value", "left")
        score = marked.groupBy("pattern").agg(F.count("is_known").alias("support"), F.count("*").alias("n"))
        trusted = score.filter((F.col("support") >= min_support) & (F.col("support") >= min_confidence * F.col("n"))).select("pattern")
        reached = links.join(trusted, "pattern", "left_semi").select("value")
        known = cut(known.unionByName(reached).distinct())
        before, count = count, known.count()
    return graph.filter(~F.col("known")).join(known, "value", "left_semi").select("uid", "start", "end").distinct()


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (and n_id) of every row of docs.

    Base spans are leftmost and non-overlapping per kind; a match that fails its check is
    dropped without retry. spans lists base and discovered spans by start, then kind.
    Null texts are empty; texts without spans have an empty list. Repeated rows are
    scanned each. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).withColumn("uid", F.monotonically_increasing_id())
    found = cut(base_entities(rows).drop("text"))
    extra = discovered(found).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("ids"))
    rank = {k: i for i, k in enumerate((*KINDS, "id"))}
    named = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank[kind]).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    base = F.array_sort(F.concat(*[named(F.col(k), k) for k in KINDS]))
    merged = F.array_sort(F.concat(base, F.when(F.col("ids").isNotNull(), named(F.col("ids"), "id")).otherwise(F.slice(base, 1, 0))))
    return found.join(extra, "uid", "left").select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(merged).alias("spans"),
        F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("bigint").alias("n_id"),
    )
