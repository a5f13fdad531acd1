"""URL filter: rules first, then the log-likelihood ratio of two character models. DataFrame operations only.

Models: variable-order Markov models of characters, one for accepted and one for rejected URLs. A gram of k + 1
characters gives its last character after k others the probability

    p(s | c) = (n(cs) + MASS * p(s | shorter c)) / (n(c) + MASS),

down to 1 / ALPHABET for all characters. A character is judged after the longest context with which it was seen, so a URL's score is the
sum, over its characters, of the log ratio at that gram, divided by their number. As every suffix of a seen gram was seen,
the log ratio at the longest seen gram is the sum of what each seen gram adds over its suffix. Scoring is then one
inner join of the grams at every place with the table of additions and one sum for each URL; no place needs a group
of its own.

The models see the whole URL as it stands, scheme, query and fragment included, as often as it occurs; host and path are for
the rules. The grams of a URL are listed once, however often it occurs, and counted with partial sums before the shuffle. The table of
additions is counted: up to ``BROADCAST_GRAMS`` rows are broadcast, more are joined by shuffle, where adaptive execution splits hot
grams. Only a number stands for a URL in the rows of its grams, which come from as many tasks as its characters call for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, tasks_for

#: Characters in the longest gram.
LONGEST = 5
MASS = 4.0
ALPHABET = 256
#: Places in one piece of a URL.
PIECE = 256
#: Rows of the table of additions that are broadcast, at most; about 100 bytes each.
BROADCAST_GRAMS = 200_000
#: Characters whose grams one task lists, at most, and at least if there are cores for more tasks.
MOST_CHARS, LEAST_CHARS = 1 << 24, 1 << 16
#: Stand before and after a URL; neither is allowed in one.
_START, _END = "\x02", "\x03"

#: (verdict, host, path) of the rules in force.
RULES: tuple[tuple[str, str, str], ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _rest(url: Column) -> Column:
    """What follows the first ``://``, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """After ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for a null URL or one without ``://``."""
    found = F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for a null URL or one without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_columns(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict): the longest rule whose host the URL's host is or lies under and whose path begins the URL's path."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones win
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _text(url: Column) -> Column:
    """The characters that the models see: all of the URL; none of a null one."""
    return F.concat(F.lit(_START), F.coalesce(url, F.lit("")), F.lit(_END))


def _grams(urls: DataFrame, *keys: str) -> DataFrame:
    """keys, gram: every gram of up to LONGEST characters at every place after the start. Long URLs are cut into overlapping pieces, so the work grows with their length."""
    pieces = urls.select(*keys, "chars", F.explode(F.sequence(F.lit(2), F.length("chars"), F.lit(PIECE))).alias("at"))
    lead = F.least(F.lit(LONGEST - 1), F.col("at") - 1)
    pieces = pieces.select(*keys, lead.alias("lead"), F.substring("chars", F.col("at") - lead, lead + PIECE).alias("piece"))
    places = F.sequence(F.col("lead") + 1, F.length("piece"))
    grams = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.least(i, F.lit(LONGEST))), lambda k: F.substring(F.col("piece"), i - k + 1, k))))
    return pieces.select(*keys, F.explode(grams).alias("gram"))


def _additions(training: DataFrame, scratch: Scratch) -> DataFrame:
    """(gram, added): what a gram adds to the log ratio, accepted over rejected, that its suffix gives."""
    training = training.withColumn("good", (F.col("listed") == "allow").cast("int"))
    table = _grams(training, "good", "times").groupBy("gram").agg(F.sum(F.col("times") * F.col("good")).alias("a"), F.sum(F.col("times") * (1 - F.col("good"))).alias("r"))
    table = scratch.write(table.withColumn("k", F.length("gram")), "grams")
    # A context's count is the sum over what follows it.
    context = F.substring("gram", F.lit(1), F.col("k") - 1)
    contexts = table.groupBy(context.alias("context"), F.col("k")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
    table = table.withColumn("context", context).join(contexts, ["context", "k"])
    level = out = None
    for k in range(1, LONGEST + 1):
        now = table.where(F.col("k") == k)
        if level is None:
            now = now.withColumn("pa", F.lit(1.0 / ALPHABET)).withColumn("pr", F.lit(1.0 / ALPHABET)).withColumn("below", F.lit(0.0))
        else:
            now = now.withColumn("suffix", F.substring("gram", F.lit(2), F.lit(k - 1))).join(level.select(F.col("gram").alias("suffix"), "pa", "pr", F.col("ratio").alias("below")), "suffix")
        pa, pr = ((F.col(n) + MASS * F.col(p)) / (F.col(c) + MASS) for n, p, c in (("a", "pa", "ca"), ("r", "pr", "cr")))
        now = now.select("gram", pa.alias("pa"), pr.alias("pr"), "below").withColumn("ratio", F.log(F.col("pa") / F.col("pr")))
        level = scratch.write(now.select("gram", "pa", "pr", "ratio", (F.col("ratio") - F.col("below")).alias("added")), "ratios")
        added = level.select("gram", "added")
        out = added if out is None else out.unionByName(added)
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Judge every URL.

    pages: page_id, url; other columns are left aside. Returns one row per row of pages: page_id, host, path, rule (its
    host and path, or null), verdict (allow or block) and score (log ratio a character under the models; null where a
    rule decides). The models learn from the URLs that rules decide, each as often as it occurs. A URL that no rule fits is
    blocked if its score is below the threshold, which lies between the two classes' mean training scores, nearer to the class
    with the smaller deviation.
    Defined cases: a null URL or one without ``://`` has an empty host and path, which no rule fits, and is judged by the models
    like any other, on all its characters (none of a null one); without training URLs of both classes, URLs that no rule fits are allowed; repeated rows are
    judged each; an empty table gives an empty one.
    """
    scratch = Scratch(pages.sparkSession)
    parts = pages.select(F.col("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), _text(F.col("url")).alias("chars"))
    rule, listed = _rule_columns(rules)
    parts = parts.withColumn("rule", rule).withColumn("listed", listed)
    # Equal URLs are counted and scored once.
    distinct = parts.groupBy("chars", "listed").agg(F.count("*").alias("times"))
    distinct = scratch.write(distinct.withColumn("url_id", F.monotonically_increasing_id()), "urls")
    classes = {x["listed"]: x["n"] for x in distinct.where("listed is not null").groupBy("listed").agg(F.sum("times").alias("n")).collect()}
    if len(classes) < 2:
        return parts.select("page_id", "host", "path", "rule", F.coalesce("listed", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    chars = int(distinct.agg(F.sum(F.length("chars"))).first()[0])
    spread_out = distinct.repartition(tasks_for(pages.sparkSession, chars, MOST_CHARS, LEAST_CHARS), "url_id")
    additions = scratch.write(_additions(spread_out.where("listed is not null"), scratch), "additions")
    looked_up = F.broadcast(additions) if additions.count() <= BROADCAST_GRAMS else additions
    sums = _grams(spread_out, "url_id").join(looked_up, "gram").groupBy("url_id").agg(F.sum("added").alias("total"))
    score = F.coalesce(F.col("total") / (F.length("chars") - 1), F.lit(0.0))
    scored = scratch.write(distinct.join(sums, "url_id", "left").select("chars", "listed", "times", score.alias("score")), "scores")
    mean = F.sum(F.col("score") * F.col("times")) / F.sum("times")
    square = F.sum(F.col("score") * F.col("score") * F.col("times")) / F.sum("times")
    spread = {x["listed"]: (x["m"], max(x["v"], 0.0) ** 0.5) for x in scored.where("listed is not null").groupBy("listed").agg(mean.alias("m"), (square - mean * mean).alias("v")).collect()}
    (good, a), (bad, r) = spread["allow"], spread["block"]
    threshold = (good * r + bad * a) / (a + r) if a + r > 0 else (good + bad) / 2
    open_ = scored.where("listed is null").select("chars", "score")
    verdict = F.coalesce("listed", F.when(F.col("score") < threshold, "block").otherwise("allow"))
    return parts.join(open_, "chars", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
