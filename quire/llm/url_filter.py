"""URL filters: given rules first, then association rules mined by FP-growth from the URLs that the rules label.

A URL's tokens are its host's labels, its suffixes of two labels and its path's segments. FP-growth finds token sets
that go with a verdict; rules of enough support and confidence are kept, shorter ones before longer ones that add
nothing. Matching goes through an inverted index from tokens to rules: a rule fires when all its tokens are met.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The given rules (verdict, rule); a rule is a host and a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Least share of the labelled URLs for a token set, and least confidence of a rule. At most 1 / SUPPORT tokens a token
#: place can be frequent, which bounds the mined sets.
SUPPORT, CONFIDENCE = 0.005, 0.8
#: A rule's confidence lies above its verdict's share of all labelled URLs by this part of what is left up to 1, at least.
MARGIN = 0.25
#: Tokens in the longest rule, the verdict left out.
LONGEST = 3
#: Rules up to this count are broadcast (some 200 bytes each); more are joined by shuffle.
BROADCAST_RULES = 50_000


def url_parts(url: str = "url") -> tuple[F.Column, F.Column]:
    """host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    rest = F.expr(f"case when {url} like '%://%' then substring({url}, locate('://', {url}) + 3) else '' end")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_of(host: F.Column, path: F.Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits, and its verdict; both null if none does. Of equal lengths the first given wins."""
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for said, text in sorted(rules, key=lambda r: -len(r[1])):
        at, slash, rest = text.partition("/")
        fits = (host == at) | host.endswith("." + at)
        fits = fits & path.startswith(slash + rest)
        rule, verdict = rule.when(fits, text), verdict.when(fits, said)
    return rule, verdict


def url_tokens(host: F.Column, path: F.Column) -> F.Column:
    """Distinct tokens of a whole URL: labels by place from the right, the host's suffix of two labels, segments by place."""
    labels = F.reverse(F.split(host, r"\."))
    by_place = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    suffix = F.array(F.concat(F.lit("s:"), F.concat_ws(".", F.reverse(F.slice(labels, 1, 2)))))
    parts = F.split(path, "/")
    segments = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x))
    return F.filter(F.array_distinct(F.concat(by_place, suffix, segments)), lambda x: ~x.rlike(r"^\w+:$"))


def mine_rules(labelled: DataFrame) -> DataFrame:
    """Rules (id, tokens, n, verdict, confidence, support) from labelled (tokens, verdict), deterministic in their order.

    Tokens that stand in the same URLs are one item, named by the first of them: what is always met together, such as
    a long shared path, does not multiply the token sets. Without labelled URLs there are no rules.
    """
    spark = labelled.sparkSession
    schema = "rule_id int, tokens array<string>, n int, verdict string, confidence double, support double"
    total = labelled.count()
    share = {r.verdict: r["count"] / total for r in labelled.groupBy("verdict").count().collect()}  # two rows
    if not total:
        return spark.createDataFrame([], schema)
    rows = materialize(labelled.where("size(tokens) > 0").withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(row))").alias("x"), F.expr("sum(pmod(xxhash64(row, 1), 1099511627776))").alias("y"))
    names = each.where(F.col("n") >= SUPPORT * total).groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token")  # at most 1 / SUPPORT a place
    told = rows.select("row", "verdict", F.explode("tokens").alias("token")).join(F.broadcast(names), "token").groupBy("row", "verdict").agg(F.collect_set("token").alias("tokens"))
    items = told.select(F.concat("tokens", F.array(F.concat(F.lit("v:"), "verdict"))).alias("items"))
    if items.isEmpty():
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=SUPPORT, minConfidence=CONFIDENCE).fit(items)
    found = model.associationRules.where(F.expr(f"size(consequent) = 1 and consequent[0] like 'v:%' and size(antecedent) <= {LONGEST} and not exists(antecedent, x -> x like 'v:%')"))
    rows = sorted((tuple(sorted(r.antecedent)), r.consequent[0][2:], r.confidence, r.support) for r in found.collect())
    rows = [r for r in rows if r[2] >= share[r[1]] + MARGIN * (1 - share[r[1]]) - 1e-9]
    rows.sort(key=lambda r: (len(r[0]), r[0]))
    kept: dict[tuple, tuple] = {}
    for tokens, verdict, confidence, support in rows:  # a longer rule must beat every shorter one inside it
        inside = [kept[t] for t in subsets(tokens) if t in kept]
        if all(confidence > c + 1e-9 or verdict != v for v, c, _ in inside):
            kept[tokens] = verdict, confidence, support
    return spark.createDataFrame([(i, list(t), len(t), *kept[t]) for i, t in enumerate(kept)], schema)


def subsets(tokens: tuple[str, ...]) -> list[tuple[str, ...]]:
    from itertools import combinations

    return [c for n in range(1, len(tokens)) for c in combinations(tokens, n)]


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url), and by: rule, mined or default.

    Mined rules decide where no given rule fits: the fitting one of greatest confidence, then most tokens, then
    lowest id. Where none fires, the verdict is `otherwise`. A null URL, or one without `://`, has an empty host and
    path and no rule. Repeated rows come back as often as given, other columns are left aside, an empty table gives an
    empty result.
    """
    host, path = url_parts()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), said.alias("said"), url_tokens(F.col("host"), F.col("path")).alias("tokens"))
    # What tells a URL's verdict depends on its host and path alone, so each pair is matched once.
    unique = materialize(rows.select("host", "path", "rule", "said", "tokens").distinct())
    labelled = materialize(rows.where("said is not null").select("tokens", F.col("said").alias("verdict")))
    mined = materialize(mine_rules(labelled))
    index = mined.select(F.explode("tokens").alias("token"), "rule_id", "n", F.col("verdict").alias("mined"), "confidence")
    open_urls = unique.where("said is null").select("host", "path", F.explode("tokens").alias("token"))
    few = mined.count() <= BROADCAST_RULES
    fired = (
        open_urls.join(F.broadcast(index) if few else index, "token").groupBy("host", "path", "rule_id", "n", "mined", "confidence").count().where("count = n")
        .groupBy("host", "path").agg(F.expr("max_by(mined, struct(confidence, n, -rule_id))").alias("mined"))
    )
    fired = materialize(fired)
    return rows.join(fired, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", "mined", F.lit(otherwise)).alias("verdict"), F.expr("case when said is not null then 'rule' when mined is not null then 'mined' else 'default' end").alias("decided_by")
    )
