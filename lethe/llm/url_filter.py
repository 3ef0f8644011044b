"""URL filter: allow and block rules, and a ratio of two character models.

A URL that a rule fits takes the rule's verdict.  The others are judged by
two smoothed Markov models of characters, one of the URLs that rules accept
and one of those they reject.  Their order varies: a context seen often
decides nearly alone, a rare one leans on the next shorter one, an unseen one leaves it
to that.  The score is the difference of the two log-likelihoods per
character; the cut comes from labelled URLs that were not counted.

Everything is DataFrame operations.  The models are tables of distinct
character strings, joined to the strings of the URLs; each distinct URL is
cut up once, whatever number of pages has it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions.arrays import let
from lethe.llm.common import lower_ascii, staged

# Characters of the longest context.
ORDER = 4
# Weight of the shorter context's estimate, in characters seen.
SMOOTH = 2.0
# Probability of a character without any context: one of so many.
CHARACTERS = 1000
_BEGIN, _END = "\x02", "\x03"
# One in so many labelled URLs is kept for the cut.
HELD = 5


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host_of(url) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url) -> Column:
    """After the host up to ? or # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules=RULES) -> Column:
    """Number of the longest rule that fits (of equals the longer host), or null."""
    out = None
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host)), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        k = F.lit(rules.index(r))
        out = F.when(fits, k) if out is None else out.when(fits, k)
    return F.lit(None).cast("int") if out is None else out


def _strings(url) -> Column:
    """The ORDER + 1 characters that end at each character of a URL and at its
    end.  The URL is cut into characters once, so the work is linear."""
    padded = F.concat(F.lit(_BEGIN * ORDER), url, F.lit(_END))
    return let(F.split(padded, ""), lambda c: F.transform(
        F.sequence(F.lit(0), F.size(c) - ORDER - 1), lambda i: F.concat(*[F.get(c, i + k) for k in range(ORDER + 1)])))


def _models(strings: DataFrame) -> DataFrame:
    """``strings(g, a, b)``: each distinct string with its counts in accepted
    and rejected URLs -> (g, r): log ratio of the two models' probabilities
    of its last character after the others."""
    below = None
    for k in range(ORDER + 1):
        seen = (strings.groupBy(F.substr("g", F.lit(ORDER + 1 - k), F.lit(k + 1)).alias("s"))
                .agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
        seen = seen.withColumn("c", F.substr("s", F.lit(1), F.lit(k)))
        context = seen.groupBy("c").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
        level = seen.join(context, "c")
        if below is None:
            pa = pb = F.lit(1.0 / CHARACTERS)
        else:
            level = level.withColumn("shorter", F.substr("s", F.lit(2), F.lit(k))).join(below, "shorter")
            pa, pb = F.col("pa"), F.col("pb")
        below = level.select(F.col("s").alias("shorter"),
                             ((F.col("a") + SMOOTH * pa) / (F.col("ca") + SMOOTH)).alias("pa"),
                             ((F.col("b") + SMOOTH * pb) / (F.col("cb") + SMOOTH)).alias("pb"))
    return below.select(F.col("shorter").alias("g"), F.log(F.col("pa") / F.col("pb")).alias("r"))


def best_cut(bins: list[tuple[float, int, int]]) -> float:
    """The score with the best mean of the two shares judged rightly (of
    equals the one nearest 0), from (score, accepted, rejected) counts; a URL
    is allowed from the cut on.  0 without both labels."""
    accepted, rejected = sum(x[1] for x in bins), sum(x[2] for x in bins)
    if not accepted or not rejected:
        return 0.0
    best, cut, above, below = -1.0, 0.0, accepted, 0
    for score, a, b in sorted(bins):
        gain = above / accepted + below / rejected
        if (gain, -abs(score)) > (best, -abs(cut)):
            best, cut = gain, score
        above, below = above - a, below + b
    return cut


def _of_rule(values: list[str]) -> Column:
    """The value of rule number k, null without a rule."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(F.col("k") == i, v).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), a row per row of ``pages``.

    rule: the fitting rule's name or null; verdict: the rule's, else the
    models'; score: the models' (null under a rule).  A null URL, or one
    without ``://``, has an empty host and path; its text is judged by the
    models (null as empty).  A URL of any length is read whole, in work and
    rows linear in it; pages that share a URL share its score.  Without accepted and rejected URLs to learn from
    both models are alike and every score is 0: allow."""
    url = F.coalesce(pages["url"], F.lit(""))
    host, path = host_of(pages["url"]), path_of(pages["url"])
    rows = pages.select(pages["page_id"], host.alias("host"), path.alias("path"), url.alias("url"))
    # A URL's strings go with its 128-bit hash, not with the URL itself.
    rows = rows.withColumn("k", rule_of(F.col("host"), F.col("path"), rules)).withColumn("u", F.unhex(F.md5("url")))
    verdicts, names = _of_rule([r.verdict for r in rules]), _of_rule([r.name for r in rules])
    # Each distinct URL once, dealt out by count, as each becomes many strings;
    # what follows :// is what the models read.
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = rows.select("url", "u", "k").distinct().repartition(n, "u").withColumn("told", verdicts)
    urls = urls.withColumn("held", F.crc32(F.col("url").cast("binary")) % HELD == 0)
    body = F.regexp_replace("url", r"(?s)^.*?://", "")
    cut_up = urls.select("u", "k", "told", "held", F.explode(_strings(lower_ascii(body))).alias("g"))
    counted = F.col("told").isNotNull() & ~F.col("held")
    # Both are read several times below.
    strings = staged(cut_up.groupBy("g").agg(
        F.sum(F.when(counted & (F.col("told") == "allow"), 1).otherwise(0)).alias("a"),
        F.sum(F.when(counted & (F.col("told") == "block"), 1).otherwise(0)).alias("b")))
    judged = cut_up.where("k is null or held")
    scores = staged(judged.join(_models(strings), "g").groupBy("u", "told").agg(F.avg("r").alias("score")))
    # At most 2001 bins whatever the number of URLs.
    bins = (scores.where(F.col("told").isNotNull())
            .groupBy(F.round(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("score"))), 2).alias("bin"))
            .agg(F.count(F.when(F.col("told") == "allow", 1)).alias("a"),
                 F.count(F.when(F.col("told") == "block", 1)).alias("b")).collect())
    cut = best_cut([(r.bin, r.a, r.b) for r in bins])
    own = scores.where(F.col("told").isNull()).select(F.col("u").alias("judged"), "score")
    joined = rows.join(own, (F.col("u") == F.col("judged")) & F.col("k").isNull(), "left")
    return joined.select("page_id", "host", "path", names.alias("rule"),
                         F.coalesce(verdicts, F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"),
                         "score")
