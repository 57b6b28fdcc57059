"""Personal data: base rules, and identifiers that seed contexts discover, in DataFrame expressions alone.

One pass over the texts cuts each text at the matches of each rule.  Of the
pieces only their lengths, the matches and the last two words of the others go on, one
row per document, and positions are running sums of lengths.

The bootstrap then works on a bipartite graph.  Instances are the valid base matches (the
seeds), all blank-delimited tokens with a digit or @, and runs of such tokens parted by single
blanks (grouped numbers), which take the place of their first token; patterns are the two words
before them, however long, where an earlier match of the rule counts as the word ``<rule>``.  In turn a pattern is trusted by the share of its instances that are
known to be of a kind, and an instance by its best pattern, for ``ROUNDS`` rounds.  Tokens
and groups of trusted patterns that overlap no base span are the added spans, of those that begin at one
place the longest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

KINDS = ("email", "ip", "card", "phone")
#: Rounds of the bootstrap; trust and distinct known instances that a pattern needs.
ROUNDS, TRUST, SUPPORT = 3, 0.7, 5

_CUT = "\ue000"
#: The base rules.  Possessive forms and look-behinds match what the plain ones do, without trying a run again from its middle.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+",
    "group": r"(?<!\S)[^\s0-9@]*+[0-9][^\s@]*+(?:(?<![.,;:!?])\x20[^\s0-9@]*+[0-9][^\s@]*+(?!\S))++",
}
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "token": "[0-9@]",
          "group": r"(?<!\S)[^\s0-9@]*+[0-9][^\s@]*+\x20[^\s0-9@]*+[0-9]"}
_UNNAMED = ("token", "group")
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _pieces(text: Column, kind: str) -> Column:
    """array<(len, match, before)>: stretches between matches (with their last one or two words) and matches by turns, empty if nothing matches."""
    cut = F.split(F.regexp_replace(text, RULES[kind], f"{_CUT}$0{_CUT}"), _CUT, -1)
    # Read backwards, so that the last words are found from the end, whatever their length.
    last = lambda p: F.lower(F.reverse(F.regexp_extract(F.reverse(p), r"^\s*+(\S++(?:\s++\S++)?+)", 1)))
    turns = F.transform(cut, lambda p, i: F.struct(F.length(p).alias("len"), F.when(i % 2 == 1, p).alias("match"), F.when(i % 2 == 0, last(p)).alias("before")))
    return F.when(text.rlike(_HINTS[kind]), turns).otherwise(F.array().cast("array<struct<len:int,match:string,before:string>>"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    d = F.reverse(_digits(match))
    value = lambda i: F.substr(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(value(i) > 9, value(i) - 9).otherwise(value(i)))
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _valid(kind: Column, match: Column) -> Column:
    return (F.when(kind == "ip", match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")).when(kind == "card", _luhn(match))
            .when(kind == "phone", F.length(_digits(match)).between(9, 15)).otherwise(F.lit(True)))


def _found(rows: DataFrame) -> DataFrame:
    """(rid, kind, start, end, match, before) of all matches."""
    each = reduce(DataFrame.unionByName, [rows.select("rid", F.lit(k).alias("kind"), F.posexplode(k).alias("i", "p")) for k in RULES])
    w = Window.partitionBy("rid", "kind").orderBy("i")
    each = each.select("rid", "kind", F.sum(F.col("p.len").cast("long")).over(w).alias("end"), F.col("p.len").alias("len"),
                       F.col("p.match").alias("match"), _before(lambda n: F.lag("p.before", n).over(w)).alias("before"))
    return each.where("match is not null").select("rid", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "match", "before")


def _before(stretch) -> Column:
    """Two words before a match: of the stretch before it, else with the match before that (``<rule>``) and what stands before that one; else empty.
    ``stretch(1)`` and ``stretch(3)`` are the last words of the two stretches before, NULL where the text begins."""
    near, far, mark = stretch(1), stretch(3), F.concat(F.lit("<"), F.col("kind"), F.lit(">"))
    older = F.reverse(F.regexp_extract(F.reverse(far), r"^(\S++)", 1))
    return (F.when(near.rlike(r"\s"), near).when(far.isNull(), F.lit("")).when(near != "", F.concat_ws(" ", mark, near))
            .when(far != "", F.concat_ws(" ", older, mark)).when(stretch(5).isNull(), F.lit("")).otherwise(F.concat_ws(" ", mark, mark)))


def _grouped(found: DataFrame) -> DataFrame:
    """Adds ``covered``: a token in a group, its first one included; a group takes over its first token's context."""
    at = Window.partitionBy("rid").orderBy("start")
    reach = F.max(F.when(F.col("kind") == "group", F.col("end"))).over(at.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    context = F.max(F.when(F.col("kind") == "token", F.col("before"))).over(Window.partitionBy("rid", "start"))
    return found.withColumn("covered", (F.col("kind") == "token") & (F.coalesce(reach, F.lit(0)) > F.col("start"))).withColumn(
        "before", F.when(F.col("kind") == "group", context).otherwise(F.col("before")))


def _name(match: Column) -> Column:
    return F.lower(F.regexp_replace(match, r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$", ""))


def trusted_patterns(found: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """(before, kind, trust) of the patterns that the seeds induce."""
    some = found.where("before <> '' and not covered").withColumn("what", _name(F.col("match"))).where("what <> ''")
    seeds = staged(some.where(~F.col("kind").isin(*_UNNAMED)).groupBy("what").agg(F.min("kind").alias("kind")).withColumn("known", F.lit(1.0)), "seeds")
    edges = staged(some.select("before", "what").distinct(), "edges")
    degree = staged(edges.groupBy("before").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support), "patterns")
    known, patterns = seeds, None
    for _ in range(rounds):
        score = (edges.join(known, "what").groupBy("before", "kind").agg(F.sum("known").alias("s")).join(degree, "before")
                 .select("before", "kind", F.col("s"), (F.col("s") / (F.col("n") + 1)).alias("trust")).where((F.col("s") >= support - 0.5)))
        patterns = staged(score, "scores")
        spread = (edges.join(patterns.where(F.col("trust") >= trust), "before").join(seeds.select("what"), "what", "left_anti")
                  .groupBy("what").agg(F.max(F.struct("trust", "kind")).alias("x")).select("what", F.col("x.kind").alias("kind"), F.col("x.trust").alias("known")))
        known = staged(seeds.unionByName(spread), "known")
    best = patterns.where(F.col("trust") >= trust).groupBy("before").agg(F.max(F.struct("trust", "kind")).alias("x"))
    return staged(best.select("before", F.col("x.kind").alias("kind"), F.col("x.trust").alias("trust")), "trusted")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and hash are of the base spans, ``spans`` holds all (by kind as listed, then
    start).  Null and empty texts have none; repeated rows are judged one by one; an
    empty table gives no rows.
    """
    # A character that marks the cuts must not be in the text; its stand-in matches no rule either.
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _CUT, "\ue001")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    rows = staged(docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), *[_pieces(F.col("t"), k).alias(k) for k in RULES]), "pieces")
    found = _found(rows)
    found = staged(_grouped(found.where(_valid(F.col("kind"), F.col("match")))), "found")
    patterns = trusted_patterns(found)

    # Tokens beside base spans: running bounds of the base spans of a document tell whether one overlaps.
    is_base = ~F.col("kind").isin(*_UNNAMED)
    w = Window.partitionBy("rid").orderBy("start", "end")
    beside = found.join(found.where(~is_base).select("rid").distinct(), "rid", "left_semi")
    beside = (beside.withColumn("left", F.max(F.when(is_base, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
              .withColumn("right", F.min(F.when(is_base, F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
              .where(~is_base & (F.coalesce("left", F.lit(0)) <= F.col("start")) & (F.coalesce("right", F.col("end")) >= F.col("end"))))
    added = beside.drop("kind").join(patterns.select("before", "kind"), "before").groupBy("rid", "start").agg(F.max(F.struct("end", "kind")).alias("x"))
    reach = F.max("x.end").over(Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    added = added.withColumn("reach", reach).where(F.coalesce("reach", F.lit(0)) <= F.col("start")).select(
        "rid", "x.kind", "start", "x.end", F.lit(1).alias("added"))
    spans = found.where(is_base).select("rid", "kind", "start", "end", F.lit(0).alias("added")).unionByName(added)

    listed = F.array(*map(F.lit, KINDS))
    spans = spans.withColumn("x", F.struct(F.array_position(listed, F.col("kind")).alias("k"), "start", "end", "kind", "added"))
    write = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    per = spans.groupBy("rid").agg(F.sort_array(F.collect_list("x")).alias("all"))
    own = F.filter("all", lambda x: x.added == 0)
    count = lambda k: F.size(F.filter(own, lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    per = per.select("rid", *map(count, KINDS),
                     F.sha2(write(own), 256).alias("base_sha256"), write("all").alias("spans"),
                     (F.size("all") - F.size(own)).cast("long").alias("n_added"))
    nothing = F.sha2(F.lit(""), 256)
    out = rows.select("doc_id", "rid").join(per, "rid", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.coalesce("base_sha256", nothing).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
                      F.coalesce("n_added", F.lit(0)).cast("long").alias("n_added"))
