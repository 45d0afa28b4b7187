"""URL filters: host and path rules, and a character language-model ratio for the URLs that no rule fits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import named, written

#: Fixed by the contract: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: The models see a-z, any digit as 0, these, and * for anything else: SYMBOLS of them, with both ends of the URL.
PUNCTUATION = "./_-?=&#:"
SYMBOLS = 26 + 1 + len(PUNCTUATION) + 1 + 2
#: The longest context, in symbols. There are SYMBOLS ** (ORDER + 1) grams at most, however many URLs.
ORDER = 3
#: Weight of a context's shorter context, as so many observations.
PRIOR = 4.0
#: Up to so many grams (some 100 bytes each in memory) the ratio table is broadcast; beyond, the join shuffles.
BROADCAST_GRAMS = 200_000
#: Log ratios are summed in integers of this unit, so sums do not depend on their order.
UNIT = 1e6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path`` text, and its verdict; null where none does.

    Of equally long ones the one with the longer host, then the smaller text, wins.
    """
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0] + r[1]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    pick = lambda value: F.coalesce(*(F.when(fits(r[0], r[1]), F.lit(value(r))) for r in order), F.lit(None).cast("string"))
    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def folded(url: Column) -> Column:
    """The URL after its scheme in the models' alphabet; null is empty."""
    rest = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), r"(?s)^.*?://", "")
    return F.regexp_replace(F.regexp_replace(rest, "[0-9]", "0"), rf"[^a-z0{PUNCTUATION.replace('-', '')}-]".replace("?", r"\?"), "*")


def grams(text: Column) -> Column:
    """Each symbol behind its ORDER symbols of context, with the end of the URL as a last symbol."""
    padded = F.concat(F.lit("^" * ORDER), text, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def log_ratios(counts: DataFrame) -> DataFrame:
    """``gram, accepted, rejected`` (how often) to ``gram, ratio``: log p(accepted) - log p(rejected) of its last symbol, in UNIT.

    Each order is smoothed towards the one below it, the lowest towards equal
    probabilities; a context that a class never shows falls back wholly. So the
    order that counts varies with the evidence.
    """
    rows = counts.withColumns({"p_accepted": F.lit(1.0 / SYMBOLS), "p_rejected": F.lit(1.0 / SYMBOLS)})
    for o in range(ORDER + 1):
        tail, context = F.substring("gram", ORDER + 1 - o, o + 1), F.substring("gram", ORDER + 1 - o, o)
        sums = lambda key, name: counts.groupBy(key.alias(name)).agg(F.sum("accepted").alias(f"{name}_a"), F.sum("rejected").alias(f"{name}_r"))
        rows = rows.withColumns({"t": tail, "c": context})
        rows = rows.join(sums(tail, "t"), "t").join(sums(context, "c"), "c")
        smooth = lambda n, of, p: (F.col(n) + PRIOR * F.col(p)) / (F.col(of) + PRIOR)
        rows = rows.select("gram", smooth("t_a", "c_a", "p_accepted").alias("p_accepted"), smooth("t_r", "c_r", "p_rejected").alias("p_rejected"))
    return rows.select("gram", F.round((F.log("p_accepted") - F.log("p_rejected")) * UNIT).cast("long").alias("ratio"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, score``.

    The verdict is that of the longest fitting rule. Where none fits, two
    smoothed Markov models of variable order decide, which learn from all URLs
    with a rule, allowed and blocked ones: the mean log-likelihood difference
    per symbol is held against a threshold between the means of both classes,
    each in units of its own spread, on a fifth of the ruled URLs that the
    models do not learn from. ``score`` is the difference beyond that
    threshold, allowed from 0; it is null where a rule decides.

    Each distinct URL form is counted, scored and joined once, with how often it
    occurs. Null URLs and URLs without ``://`` have no host or path, and are
    judged by their text. Where a class has no URL to learn or calibrate from,
    the threshold is 0. Repeated rows each get their row; an empty table gives
    an empty result; further columns are ignored.
    """
    host, path = url_parts(named(url_col))
    rows = pages.select(named(id_col).alias("page_id"), host.alias("host"), path.alias("path"), folded(named(url_col)).alias("form"))
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), ruled.alias("ruled"))
    forms = (
        rows.groupBy("form")
        .agg(
            F.count(F.when(F.col("ruled") == "allow", 1)).alias("accepted"),
            F.count(F.when(F.col("ruled") == "block", 1)).alias("rejected"),
            F.count(F.when(F.col("ruled").isNull(), 1)).alias("asked"),
        )
        .withColumn("held_out", F.conv(F.substring(F.md5("form"), 1, 4), 16, 10).cast("int") % 5 == 0)
    )
    forms = written(forms)
    learnt = lambda c: F.sum(F.when(F.col("held_out"), 0).otherwise(F.col(c))).alias(c)
    # grams of every form are in the table, counted or not, so each lookup finds one
    counts = forms.select("accepted", "rejected", "held_out", F.explode(grams(F.col("form"))).alias("gram")).groupBy("gram").agg(learnt("accepted"), learnt("rejected"))
    model = written(log_ratios(written(counts)))
    if model.count() <= BROADCAST_GRAMS:
        model = F.broadcast(model)
    wanted = forms.where((F.col("asked") > 0) | F.col("held_out"))
    scored = (
        wanted.select("form", F.explode(grams(F.col("form"))).alias("gram"))
        .groupBy("form", "gram").agg(F.count(F.lit(1)).alias("n"))
        .join(model, "gram")
        .groupBy("form").agg((F.sum(F.col("ratio") * F.col("n")) / F.sum("n") / UNIT).alias("mean"))
    )
    scored = written(scored)
    at = threshold(forms.where("held_out").join(scored, "form"))
    asked = scored.select(F.col("form").alias("s_form"), (F.col("mean") - at).alias("score"))
    found = rows.join(asked, (F.col("form") == F.col("s_form")) & F.col("ruled").isNull(), "left")
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("score") >= 0, "allow").otherwise("block"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def threshold(held_out: DataFrame) -> float:
    """Between the classes' mean scores, as many standard deviations from either; six numbers come to the driver."""
    moments = lambda c: (F.sum(c), F.sum(F.col(c) * F.col("mean")), F.sum(F.col(c) * F.col("mean") ** 2))
    n, x, xx, m, y, yy = held_out.agg(*moments("accepted"), *moments("rejected")).first()
    if not n or not m:
        return 0.0
    spread = lambda n, x, xx: math.sqrt(max(xx / n - (x / n) ** 2, 0.0)) + 1e-9
    s, t = spread(n, x, xx), spread(m, y, yy)
    return round((x / n * t + y / m * s) / (s + t), 9)
