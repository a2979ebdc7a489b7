"""Personal data by pattern, and by contexts learned from what the patterns found; DataFrame functions only.

Base spans come from four fixed patterns. They are the seeds of a bootstrap, and so are tokens that have the form of a
secret by themselves (SECRET): a known prefix, or 32 characters or more between quotes. Other tokens with digits or an
``@`` are candidates: single tokens, and groups of digits joined by blanks, dots, hyphens or brackets.

What stands around a seed or a candidate makes its lexical patterns: the word before; the two words before; the word
before and the one after; the sign before, quotes left out. So does its form: the kinds of its characters, and whether it
is long. Patterns and instances are a graph. In each round a pattern's confidence in a kind is the mean of what its
distinct instances score for the kind, and an instance's score is the noisy-or of its patterns; seeds stay certain.
Candidates that reach CONFIDENT become spans of that kind wherever they occur with a pattern of their surroundings that
reaches it too; a form alone never decides. Patterns count with LEAST_SEEDS distinct seeds or more. What a kind demands of
its digits holds for candidates as for seeds: a candidate that can't be a card, an address or a phone number scores
nothing as one. ``pattern_report`` tells what was learned from what, round by round.

Offsets are code points, end exclusive. A pattern's matches and the text between them come from the same left-to-right
scan, and a running sum over them gives the places; patterns start only where a run of their characters starts, so that
a scan stays linear in the text.

Cases: a null text is empty; repeated rows are separate rows with equal results; overlapping matches of different kinds
all count; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, keeps, written

KINDS = ("email", "ip", "card", "phone")
# fixed values: the base patterns, written so that a scan can't backtrack
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the bootstrap may add: the base kinds, and secrets.
LEARNED = (*KINDS, "secret")
#: Tokens that may be identifiers: groups of digits, or a token with a digit or an @.
CANDIDATE = r"(?<![A-Za-z0-9@._+-])(?:\(?[0-9]++(?:[\x20.()-]{1,2}[0-9]++){1,18}+(?![A-Za-z0-9@_+-])|[A-Za-z._+-]*+[0-9@][A-Za-z0-9@._+-]*+)"
# fixed values: prefixes of keys that services hand out
SECRET = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[opusr]_[0-9A-Za-z]{36}$|^xox[abprs]-[0-9A-Za-z-]{10,}$"
ROUNDS, CONFIDENT, LEAST_SEEDS, LEAST_DIGITS, CONTEXT = 3, 0.8, 3, 4, 48


def _pieces(df: DataFrame, kinds: dict[str, str], needs: dict[str, Column]) -> DataFrame:
    """For each kind an array of its matches in ``text``: characters before it since the last, the match, its context."""
    found = df.select("*", *[F.when(needs[k], F.regexp_extract_all("text", F.lit(p), 0)).alias(f"{k}_m") for k, p in kinds.items()])
    gaps = found.select("*", *[F.when(F.size(f"{k}_m") > 0, F.split("text", p, -1)).alias(f"{k}_g") for k, p in kinds.items()])

    def pieces(k: str) -> Column:
        m, g = F.col(f"{k}_m"), F.col(f"{k}_g")
        one = lambda i: F.struct(
            F.length(F.get(g, i)).alias("gap"), F.get(m, i).alias("value"), F.right(F.get(g, i), F.lit(CONTEXT)).alias("left"), F.left(F.get(g, i + 1), F.lit(CONTEXT)).alias("right"))
        return F.when(F.size(m) > 0, F.transform(F.sequence(F.lit(0), F.size(m) - 1), one)).alias(k)

    return gaps.select("rid", "doc_id", *[pieces(k) for k in kinds])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's check."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  i-th from the right, from 0
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    parts = F.forall(F.split(value, r"\."), lambda x: x.cast("double") <= 255)
    return (
        F.when(kind == "ip", parts)
        .when(kind == "card", F.when((n >= 13) & (n <= 19), luhn(_digits(value))).otherwise(False))
        .when(kind == "phone", (n >= 9) & (n <= 15))
        .when(kind == "candidate", (n >= LEAST_DIGITS) | value.rlike("[^@]@[^@]") | value.rlike(SECRET))
        .otherwise(True)
    )


def possible(kind: str, value: Column) -> Column:
    """Whether a candidate could be an identifier of this kind, however it is written: single digits may be told apart by other signs than in the base pattern."""
    n = F.length(_digits(value))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(_digits(value))).otherwise(False)
    if kind == "ip":
        parts = F.filter(F.split(value, "[^0-9]+"), lambda x: x != "")
        return ~value.rlike("[A-Za-z@]") & (F.size(parts) == 4) & F.forall(parts, lambda x: x.cast("double") <= 255)
    if kind == "phone":
        return ~value.rlike("[A-Za-z@]") & (n >= 7) & (n <= 15)
    return value.rlike("[^@]@[^@]") if kind == "email" else F.lit(True)


def _spans(hits: DataFrame) -> DataFrame:
    """rid, kind, start, end, value, left, right: every match that holds, with its place."""
    each = [hits.select("rid", F.lit(k).alias("kind"), F.posexplode(k).alias("pos", "m")) for k in (*KINDS, "candidate")]
    rows = reduce(DataFrame.unionByName, each).select("rid", "kind", "pos", "m.*")
    upto = Window.partitionBy("rid", "kind").orderBy("pos")  # the matches of one text
    rows = rows.withColumn("last", F.sum(F.col("gap") + F.length("value")).over(upto)).withColumn("start", F.col("last") - F.length("value"))
    core = F.when(F.col("kind") == "candidate", F.regexp_replace("value", r"[@._+-]++$", "")).otherwise(F.col("value"))
    rows = rows.withColumn("value", core).where(_valid(F.col("kind"), F.col("value")))
    return rows.select("rid", "kind", "start", (F.col("start") + F.length("value")).alias("end"), "value", "left", "right")


def _apart(spans: DataFrame) -> DataFrame:
    """The spans without candidates that overlap a base span of their text."""
    base = F.col("kind") != "candidate"
    by_start = Window.partitionBy("rid").orderBy("start", F.when(base, 0).otherwise(1))
    before = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    from_end = Window.partitionBy("rid").orderBy(F.desc("start"), F.when(base, 1).otherwise(0))  # a running minimum: frames to the end would be summed up anew for each row
    after = F.min(F.when(base, F.col("start"))).over(from_end.rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.withColumn("before", before).withColumn("after", after)
    clear = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))
    return marked.where(base | clear).drop("before", "after")


def _form(value: Column) -> Column:
    """The kinds of characters of a value, and whether it is long."""
    letters = F.when(value.rlike("^[0-9]+$"), "digits").when(value.rlike("^(?=.*[a-f])[0-9a-f]+$"), "hex").when(value.rlike("^[0-9a-z]+$"), "lower").when(value.rlike("^[0-9A-Z]+$"), "upper").when(value.rlike("^[0-9A-Za-z]+$"), "mixed")
    signs = F.concat(F.lit("signs "), F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(value, "[0-9A-Za-z]", ""), ""))), ""))
    return F.concat(F.coalesce(letters, signs), F.when(F.length(value) >= 16, " long").otherwise(" short"))


def _contexts(spans: DataFrame) -> DataFrame:
    """Each span once for each of its lexical patterns; ``near`` tells those of its surroundings from those of its form."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    left = F.filter(F.split(plain(F.col("left")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    right = F.filter(F.split(plain(F.col("right")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    word = lambda words, i: F.coalesce(F.try_element_at(words, F.lit(i)), F.lit(""))
    sign = F.regexp_extract("left", r"""([^\x20\x09-\x0DA-Za-z0-9"'])[\x20"']*$""", 1)
    made = spans.withColumn("l", left).withColumn("r", right)
    patterns = F.array(
        F.struct(F.concat(word("l", -1), F.lit(" _")).alias("pattern"), F.lit(True).alias("near")),
        F.struct(F.concat(word("l", -2), F.lit(" "), word("l", -1), F.lit(" _")).alias("pattern"), F.lit(True).alias("near")),
        F.struct(F.concat(word("l", -1), F.lit(" _ "), word("r", 1)).alias("pattern"), F.lit(True).alias("near")),
        F.struct(F.concat(F.lit("sign "), sign).alias("pattern"), F.lit(True).alias("near")),
        F.struct(F.concat(F.lit("form "), _form(F.col("value"))).alias("pattern"), F.lit(False).alias("near")),
    )
    return made.withColumn("p", F.explode(patterns)).select(*spans.columns, "p.*").where("pattern NOT IN ('sign ', ' _')")


def _seeds(spans: DataFrame) -> DataFrame:
    """The spans, with candidates that are secrets by their form as seeds of that kind."""
    quoted = (F.length("value") >= 32) & F.col("value").rlike("[0-9].*[0-9].*[0-9].*[0-9]") & F.col("left").rlike("[\"']$") & F.col("right").rlike("^[\"']")
    return spans.withColumn("kind", F.when((F.col("kind") == "candidate") & (F.col("value").rlike(SECRET) | quoted), "secret").otherwise(F.col("kind")))


def learned(spans: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, least_seeds: int = LEAST_SEEDS) -> tuple[DataFrame, DataFrame]:
    """rid, kind, start, end of the candidates that the bootstrap adds; and the patterns: round, pattern, kind, seeds, instances, confidence."""
    kinds = LEARNED
    seen = written(_contexts(spans).select("rid", F.col("kind").alias("found_as"), "start", "end", F.lower("value").alias("instance"), "pattern", "near"), "contexts")
    edges = written(seen.groupBy("pattern", "instance").agg(*[F.max((F.col("found_as") == k).cast("int")).alias(f"seed_{k}") for k in kinds]), "graph")
    support = edges.groupBy("pattern").agg(F.count("*").alias("n"), *[F.sum(f"seed_{k}").alias(f"n_{k}") for k in kinds])
    usable = written(support.where(reduce(Column.__or__, [F.col(f"n_{k}") >= least_seeds for k in kinds])), "patterns")
    graph = written(edges.join(usable, "pattern"), "edges")
    scores = written(graph.groupBy("instance").agg(*[F.max(f"seed_{k}").cast("double").alias(k) for k in kinds]), "instances")
    rules: list[DataFrame] = []
    for _ in range(rounds):
        rated = graph.join(scores, "instance")
        share = lambda k: F.when(F.max(f"n_{k}") >= least_seeds, F.sum(k) / F.count("*")).otherwise(0.0)
        rules.append(written(rated.groupBy("pattern").agg(F.count("*").alias("instances"), *[F.max(f"n_{k}").alias(f"n_{k}") for k in kinds], *[share(k).alias(f"p_{k}") for k in kinds]), "confidence"))
        doubt = lambda k: F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col(f"p_{k}"))))
        told = lambda k: F.when(possible(k, F.col("instance")), 1 - F.exp(doubt(k))).otherwise(0.0)
        again = graph.join(rules[-1].select("pattern", *[f"p_{k}" for k in kinds]), "pattern").groupBy("instance").agg(*[F.greatest(F.max(f"seed_{k}").cast("double"), told(k)).alias(k) for k in kinds])
        again = written(again, "instances")
        drop_written(scores)
        scores = again
    kind = F.greatest(*[F.struct(F.col(k).alias("by"), F.lit(k).alias("kind")) for k in kinds])
    sure = scores.select("instance", kind.alias("k")).where(F.col("k.by") >= confident).select("instance", F.col("k.kind").alias("kind"))
    held = rules[-1].select("pattern", *[F.when(F.col(f"p_{k}") >= confident, F.lit(k)).alias(f"is_{k}") for k in kinds]).where(F.coalesce(*[f"is_{k}" for k in kinds]).isNotNull())
    out = seen.where("found_as = 'candidate' AND near").join(held, "pattern").join(sure, "instance").where(F.array_contains(F.array(*[f"is_{k}" for k in kinds]), F.col("kind")))
    out = written(out.select("rid", "kind", "start", "end").distinct(), "learned")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("seeds"), F.col(f"p_{k}").alias("confidence")) for k in kinds])).alias("k")
    told = [r.select(F.lit(i + 1).alias("round"), "pattern", "instances", each).select("round", "pattern", "k.kind", "k.seeds", "instances", "k.confidence").where("confidence > 0") for i, r in enumerate(rules)]
    patterns = written(reduce(DataFrame.unionByName, told), "learned-patterns")
    drop_written(seen, edges, usable, graph, scores, *rules)
    return out, patterns


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, confident: float = CONFIDENT, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """doc_id, base, seeds, learned and spans of every row: arrays of (kind, start, end), by kind as in LEARNED, then start.

    ``base`` holds what the four patterns find, ``seeds`` secrets by their form, ``learned`` what contexts alone reveal, and
    ``spans`` all of them.
    """
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    needs = {"email": F.col("text").contains("@"), "ip": digit, "card": digit, "phone": F.col("text").contains("+"), "candidate": F.col("text").rlike("[0-9@]")}
    hits = written(_pieces(own, PATTERNS | {"candidate": CANDIDATE}, needs), "matches")
    spans = written(_seeds(_apart(_spans(hits))), "spans")
    more, patterns = learned(spans, rounds, confident, least_seeds)
    place = F.create_map(*[F.lit(x) for i, k in enumerate(LEARNED) for x in (k, i)])[F.col("kind")]
    own_kind = F.when(F.col("kind") == "secret", "seeds").otherwise("base").alias("by")
    every = spans.where("kind <> 'candidate'").select("rid", "kind", "start", "end", own_kind).unionByName(more.select("rid", "kind", "start", "end", F.lit("learned").alias("by")))
    in_order = F.array_sort(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind", "by")))  # the spans of one text
    by_row = every.groupBy("rid").agg(in_order.alias("all"))
    joined = hits.select("rid", "doc_id").join(by_row, "rid", "left")
    whole = F.coalesce("all", F.array().cast("array<struct<place:int,start:bigint,end:bigint,kind:string,by:string>>"))
    plain = lambda a: F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    part = lambda by: plain(F.filter(whole, lambda x: x["by"] == by)).alias(by)
    parts = [part(by) for by in ("base", "seeds", "learned")]
    out = keeps(joined.select("doc_id", *parts, plain(whole).alias("spans")), hits, spans, more, patterns)
    out._learned_patterns = patterns
    return out


def pattern_report(found: DataFrame) -> DataFrame:
    """round, pattern, kind, seeds, instances, confidence: what the bootstrap behind the result of ``personal_data`` learned."""
    return found._learned_patterns


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
