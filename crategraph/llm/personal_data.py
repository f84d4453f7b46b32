"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Four expressions with checks (``KINDS``) give base spans. Then the contexts of what they found discover more. *Candidates* are
all stretches that look like an identifier: what the four expressions match before any check, and tokens of five digits or
more. A candidate that passes a kind's check is a *seed* of it. A candidate's *patterns* are the word ahead of it and the two
words ahead of it, on its line. In each round a pattern's confidence for a kind is the share of all its occurrences in the
corpus, whatever follows, that precede an instance of the kind, counted with the instance's score; patterns with three
distinct instances and a confidence of 0.5 are accepted. An unknown instance scores the mean, over its occurrences, of the
best confidence of an accepted pattern there, and from 0.5 on counts as an instance in the next round. At the end unknown
candidates that are instances, those that write a seed's letters and digits in another way, and those that follow an accepted
pattern are spans of the kind, unless they meet a base span. Patterns of ordinary words ("of the") are ruled out by their own frequency.

Expressions are possessive and start where a run starts, so that a long run costs linear time; what they find is what the
plain ones find. Positions come from summing the lengths between matches in a window over a text's matches. Equal texts are
worked on once, by digest, and counted as often as they occur.

Defined results: a null text counts as ''; null ids stay null; repeated rows return once each; long texts and texts of
matches only are no special case; columns other than the two named ones are ignored, whatever they are called; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crategraph.shared import join_measured, settle

KINDS = ("email", "ip", "card", "phone")
#: Least distinct instances of a pattern, least confidence of a pattern and least score of an instance, rounds at most.
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.5, 3
#: Characters ahead of a candidate in which its words are looked for.
TAIL = 200

_LOCAL = r"[A-Za-z0-9._%+-]"
_AHEAD = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++"
EXPRESSIONS = {
    "email": _AHEAD + r"(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = "|".join([_AHEAD + r"(?:\.[A-Za-z0-9-]++)*+", EXPRESSIONS["phone"], EXPRESSIONS["ip"], r"[0-9](?:[\x20-]?+[0-9]){4,}+", r"(?:\G|(?<![A-Za-z0-9_.-]))(?:[A-Za-z_.-]*+[0-9]){5}[A-Za-z0-9_.-]*+"])
#: A line's end, or a word; a colon or an equals sign ends one.
CONTEXT_WORD = r"\n|[^\x20\x09-\x0D:=]*[:=]|[^\x20\x09-\x0D:=]+"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the check."""
    last = F.reverse(digits)
    value = lambda i: F.substring(last, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    folded = F.transform(F.sequence(F.lit(1), F.length(last)), lambda i: value(i) - F.when(value(i) > 9, 9).otherwise(0))
    return F.aggregate(folded, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """Whether a match of a kind's expression passes the kind's check."""
    size = F.length(_digits(match))
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$"),
        "card": F.when(size.between(16, 19), _luhn(_digits(match))).otherwise(False),
        "phone": size.between(8, 15),
    }[kind]


def seed_kind(match: Column) -> Column:
    """The kind whose expression is the whole match and whose check it passes, or null."""
    whole = {"email": rf"^{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$", "ip": r"^[0-9]++(?:\.[0-9]++){3}$", "card": r"^[0-9](?:[\x20-]?+[0-9])++$", "phone": r"^\+[0-9][\x20().0-9-]+[0-9]$"}
    return F.coalesce(*(F.when(match.rlike(whole[k]) & passes(k, match), k) for k in KINDS))


def _matches(docs: DataFrame) -> DataFrame:
    """(digest, kind, match, tail, m, start, end) of every match in every distinct text of ``docs`` (digest, text); kind '' for
    candidates; m: rows with the text."""
    cut = lambda kind, pattern, size: F.struct(
        F.lit(kind).alias("kind"),
        F.transform(F.split("text", pattern, -1), lambda p: F.struct(F.length(p).alias("n"), (F.right(p, F.lit(size)) if size else F.lit("")).alias("tail"))).alias("pieces"),
        F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"),
    )
    each = F.explode(F.array(*(cut(k, EXPRESSIONS[k], 0) for k in KINDS), cut("", CANDIDATE, TAIL)))
    wide = docs.select("digest", each.alias("x")).where(F.size("x.found") > 0)
    wide = wide.select("digest", "x.kind", F.posexplode(F.arrays_zip("x.pieces", "x.found")).alias("i", "z")).where("z.found IS NOT NULL")
    rows = wide.select("digest", "kind", "i", F.col("z.pieces.n").alias("n"), F.col("z.pieces.tail").alias("tail"), F.col("z.found").alias("match"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("m"))
    upto = Window.partitionBy("digest", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("n") + F.length("match")).over(upto)
    return rows.withColumn("end", end).select("digest", "kind", "match", "n", "tail", "m", (F.col("end") - F.length("match")).alias("start"), "end")


def _patterns(n: Column, tail: Column) -> Column:
    """Patterns of a candidate with ``n`` characters between it and the match before, of which ``tail`` are the last.

    Opening brackets and quotes may stand between the words and the candidate, nothing else."""
    bare = F.regexp_replace(tail, r"[\"'(\[<{]+$", "")
    words = F.regexp_extract_all(F.lower(bare), F.lit(CONTEXT_WORD), F.lit(0))
    words = F.when(n > TAIL, F.slice(words, 2, TAIL)).otherwise(words)  # the first may have lost its beginning
    one, two = F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(-2))
    good = lambda w: w.isNotNull() & (w != "\n")
    clean = bare.rlike(r"[\x20\x09-\x0D:=]$") & (F.size(words) > 0)
    last = F.when(clean, F.when(good(one), one))
    return F.filter(F.array(last, F.when(good(two), F.concat(two, F.lit(" "), last))), lambda p: p.isNotNull())


def _occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, n): how often each of ``patterns`` occurs in the texts of ``docs``, one pass over all of them."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(CONTEXT_WORD), F.lit(0))
    pairs = docs.select(words.alias("w")).select(F.explode(F.transform("w", lambda x, i: F.struct(x.alias("one"), F.when(i > 0, F.get("w", i - 1)).alias("two")))).alias("x"))
    ends = settle(patterns.select(F.substring_index("pattern", " ", -1).alias("one")).distinct())
    near = join_measured(pairs.select("x.one", "x.two"), ends, "one", "left_semi")
    each = near.select(F.explode(F.array(F.col("one"), F.concat("two", F.lit(" "), "one"))).alias("pattern")).where("pattern IS NOT NULL")
    counted = join_measured(each, patterns, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("n"))
    return settle(counted)


def bootstrap(docs: DataFrame, candidates: DataFrame, *, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame | None]:
    """(value, kind, score) of the instances: seeds with score 1, and what the contexts discover; and (digest, start, kind,
    confidence) of unknown candidates that follow an accepted pattern, None if there can't be any.

    ``candidates``: value, seed (kind or null), patterns, m and their place (digest, start)."""
    edges = settle(candidates.select("value", "m", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.sum("m").alias("m")))
    seeds = settle(candidates.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct())
    unknown = candidates.where("seed IS NULL").join(seeds.select("value"), "value", "left_anti")
    unknown = settle(unknown.select("digest", "start", "value", "m", "patterns"))
    weight = unknown.groupBy("value").agg(F.sum("m").alias("all"))
    known: DataFrame | None = None
    there: DataFrame | None = None
    instances = seeds
    for _ in range(rounds):
        masses = edges.join(instances, "value").groupBy("pattern", "kind").agg(F.sum(F.col("m") * F.col("score")).alias("mass"), F.count("*").alias("support"))
        masses = settle(masses.where(F.col("support") >= support))
        new = masses.select("pattern").distinct()
        new = settle(new if known is None else new.join(known, "pattern", "left_anti"))
        if not new.isEmpty():
            n = _occurrences(docs, new)
            known = n if known is None else settle(known.unionAll(n))
        if known is None:
            break
        sure = masses.join(known, "pattern").withColumn("confidence", F.round(F.col("mass") / (F.col("n") + 1), 9))
        sure = settle(sure.where(F.col("confidence") >= confidence).select("pattern", "kind", "confidence"))
        there = join_measured(unknown.select("digest", "start", "value", "m", F.explode("patterns").alias("pattern")), sure, "pattern", "inner")
        there = settle(there.groupBy("digest", "start", "value", "m", "kind").agg(F.max("confidence").alias("confidence")))
        scored = there.groupBy("value", "kind").agg(F.sum(F.col("m") * F.col("confidence")).alias("sum")).join(weight, "value")
        scored = scored.select("value", "kind", F.round(F.col("sum") / F.col("all"), 9).alias("score")).where(F.col("score") >= confidence)
        found = settle(scored)
        instances = seeds.unionAll(found)
        if found.isEmpty():
            break
    return instances, there


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) of every row; counts and digest of base spans,
    n_found spans that contexts added."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    able = F.col("text").rlike("[0-9@]")
    keyed = source.where(able).withColumn("digest", F.sha2("text", 256))
    matches = settle(_matches(keyed.select("digest", "text")))
    base = F.coalesce(*(F.when((F.col("kind") == k) & passes(k, F.col("match")), F.lit(True)) for k in KINDS), F.lit(False))
    spans = settle(matches.where("kind <> ''").where(base).select("digest", "kind", "start", "end"))
    match = F.col("match")
    value = F.lower(F.regexp_replace(match, F.when(F.contains(match, F.lit("@")), "[^A-Za-z0-9@.]").otherwise("[^A-Za-z0-9]"), F.lit("")))
    candidates = matches.where("kind = ''").select("digest", "start", "end", "m", value.alias("value"), seed_kind(match).alias("seed"), _patterns(F.col("n"), F.col("tail")).alias("patterns"))
    candidates = settle(candidates)
    instances, there = bootstrap(source, candidates, support=support, confidence=confidence, rounds=rounds)
    place = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    first = lambda by: F.min(F.struct((-F.col(by)).alias("s"), place(F.col("kind")).alias("k"), "kind"))["kind"]
    unknown = candidates.where("seed IS NULL").join(instances.groupBy("value").agg(first("score").alias("of_value")), "value", "left")
    if there is None:
        unknown = unknown.withColumn("of_place", F.lit(None).cast("string"))
    else:
        unknown = unknown.join(there.groupBy("digest", "start").agg(first("confidence").alias("of_place")), ["digest", "start"], "left")
    found = unknown.select("digest", F.coalesce("of_value", "of_place").alias("kind"), "start", "end").where("kind IS NOT NULL")
    both = spans.withColumn("base", F.lit(True)).unionAll(found.withColumn("base", F.lit(False)))
    # a found span meets a base span that begins at or ahead of its start and ends behind it, or that begins within it
    line = Window.partitionBy("digest").orderBy("start")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(line)
    then = F.min(F.when(F.col("base"), F.col("start"))).over(Window.partitionBy("digest").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1))
    both = both.withColumns({"reach": reach, "then": then})
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("then").isNull() | (F.col("then") >= F.col("end")))
    both = both.where(F.col("base") | clear)
    said = lambda xs: F.array_join(F.transform(F.array_sort(xs), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    item = F.struct(place(F.col("kind")).alias("k"), "start", "end", "kind")
    texts = both.groupBy("digest").agg(
        *(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS),
        F.collect_list(F.when(F.col("base"), item)).alias("own"),
        F.collect_list(item).alias("all"),
        F.count_if(~F.col("base")).alias("n_found"),
    )
    texts = texts.select("digest", *(f"n_{k}" for k in KINDS), F.sha2(said("own"), 256).alias("base_sha256"), said("all").alias("spans"), "n_found")
    columns = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_found"]
    fill = lambda c: F.coalesce(F.col(c), F.sha2(F.lit(""), 256) if c == "base_sha256" else F.lit("") if c == "spans" else F.lit(0).cast("bigint")).alias(c)
    joined = keyed.select("doc_id", "digest").join(texts, "digest", "left").select("doc_id", *map(fill, columns))
    bare = source.where(~able).select("doc_id", *(F.lit(0).cast("bigint").alias(f"n_{k}") for k in KINDS), F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), F.lit(0).cast("bigint").alias("n_found"))
    return joined.unionAll(bare)
