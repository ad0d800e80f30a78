"""URL filters: fixed host/path rules, and association rules mined from labels.

Spark's FP-growth mines combinations of URL tokens that go with the block label.
Tokens that occur in exactly the same labelled pages are one class: they are mined as one
item, so a long URL, whose parts come together, is not a power set of its parts. A page
has a class if it has one of its tokens, which says the same as rules of single tokens.
Rules are pruned by support, by confidence, and where a shorter rule is at least as
sure: each rule looks all its parts up. Matching is by inverted index: a rule is filed
under one of its classes (the rarest), each distinct token set looks its classes up
there, and the whole rule is then tested against the set.

Tokens: every host label (top-level domain, first label, or a label between) and
every path segment (first, last, or between), and besides the last two labels, the
number of labels, the last segment's shape, and whether there is a query. Labels
and segments between count wherever they stand.

Defined results
- null url, or no "://": host and path empty, no tokens, no rule, verdict allow
- no label at all, or none that reaches the support: no mined rule, verdict allow
- a page with several labels is blocked if any of them says so; repeated pages and
  null page_id are judged like others and kept
- fixed rules of equal length: the alphabetically last wins
- an empty table gives an empty result; other columns are not read
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import storage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label=block"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
MIN_PAGES = 2  # blocked pages that a rule needs at least, however few pages have labels
SMALL = 20_000  # rows of a table that is broadcast


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct, sorted tokens of a URL; empty for a URL without "://"."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    segments = F.filter(F.split(p, "/"), lambda s: s != "")
    first, last = F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit("")), F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    shape = F.regexp_replace(F.regexp_replace(last, r"[0-9]+", "9"), r"[^9.\-_]+", "a")
    made = F.array(
        F.concat(F.lit("tld="), F.element_at(labels, -1)),
        F.concat(F.lit("site="), F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")),
        F.concat(F.lit("sub="), F.element_at(labels, 1)),
        F.concat(F.lit("labels="), F.size(labels).cast("string")),
        F.concat(F.lit("first="), first), F.concat(F.lit("last="), last), F.concat(F.lit("shape="), shape),
        F.concat(F.lit("query="), F.contains(url, F.lit("?")).cast("string")))
    between = lambda name, all_of: F.transform(F.slice(all_of, F.lit(2), F.greatest(F.lit(0), F.size(all_of) - 2)), lambda x: F.concat(F.lit(f"{name}="), x))
    every = F.concat(made, between("inner", labels), between("segment", segments))
    known = url.isNotNull() & F.contains(url, F.lit("://"))
    return F.when(known, F.array_sort(F.array_distinct(every))).otherwise(F.array().cast("array<string>"))


def least_pages(labelled: DataFrame, min_support: float, min_pages: int) -> int:
    """How many labelled pages a rule needs at least."""
    return max(1, min_pages, math.ceil(min_support * labelled.count() - 1e-9))


def classes(labelled: DataFrame, least: int = 1) -> DataFrame:
    """token, cls: tokens that occur in the same labelled pages, at least ``least``, share a class, named after its first token.

    Pages are told by two 64-bit hashes of their baskets, summed exactly over the pages of
    a token. Rarer tokens can be in no rule; those left are at most the mean number of
    tokens a page over the support.
    """
    basket = labelled.select("tokens", F.xxhash64("tokens", "blocked").cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), "tokens", "blocked").cast("decimal(38,0)").alias("b"))
    seen = basket.select(F.explode("tokens").alias("token"), "a", "b").groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n")).where(F.col("n") >= least)
    return seen.groupBy("a", "b", "n").agg(F.sort_array(F.collect_list("token")).alias("token")).select(F.explode("token").alias("token"), F.col("token")[0].alias("cls"))


def _small(df: DataFrame) -> DataFrame:
    """``df`` broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def in_classes(sets: DataFrame, classed: DataFrame, *keys: str) -> DataFrame:
    """``keys``, items: the sorted classes of each row's tokens; rows without any are left out."""
    each = sets.select(*keys, F.explode("tokens").alias("token")).join(_small(classed), "token")
    return each.groupBy(*keys).agg(F.sort_array(F.collect_set("cls")).alias("items"))


def mine_classes(labelled: DataFrame, classed: DataFrame, least: int, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """items (classes), confidence, pages (blocked ones with all items): pruned rules, from tokens (array) and blocked (boolean)."""
    pages = labelled.groupBy("tokens", "blocked").agg(F.count("*").alias("pages"))
    sets = in_classes(pages, classed, "tokens", "blocked", "pages")
    baskets = sets.select(F.when(F.col("blocked"), F.array_append("items", BLOCK)).otherwise(F.col("items")).alias("items"), F.explode(F.array_repeat(F.lit(1), F.col("pages").cast("int"))).alias("page")).select("items")
    n = max(1, baskets.count())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0] == BLOCK).select(F.array_sort("antecedent").alias("items"), "confidence", F.round(F.col("support") * n).cast("long").alias("pages"))
    # A rule is redundant if leaving out one or more of its items is at least as sure: it looks its proper parts up.
    masks = F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2.0), F.size("items")).cast("long") - 2)
    part = lambda m: F.filter("items", lambda x, i: F.floor(m / F.pow(F.lit(2.0), i)) % 2 == 1)
    parts = rules.where(F.size("items") > 1).select("items", F.col("confidence").alias("own"), F.explode(F.transform(masks, part)).alias("part"))
    surer = parts.join(rules.select(F.col("items").alias("part"), F.col("confidence").alias("sure")), "part").where(F.col("sure") >= F.col("own"))
    return rules.join(surer.select("items").distinct(), "items", "left_anti")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """items (tokens), confidence, pages: the rules with every choice of one token for each class."""
    least = least_pages(labelled, min_support, min_pages)
    classed = classes(labelled, least)
    out = mine_classes(labelled, classed, least, min_confidence).withColumn("rule", F.col("items"))
    each = out.select("rule", "confidence", "pages", F.posexplode("items").alias("at", "cls")).join(classed, "cls")
    of = each.groupBy("rule", "confidence", "pages", "at").agg(F.collect_list("token").alias("tokens"))
    lists = of.groupBy("rule", "confidence", "pages").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"]).alias("lists"))
    none = F.array(F.array().cast("array<string>"))
    grown = F.aggregate("lists", none, lambda made, more: F.flatten(F.transform(made, lambda m: F.transform(more, lambda t: F.array_append(m, t)))))
    return lists.select(F.explode(grown).alias("items"), "confidence", "pages").withColumn("items", F.array_sort("items"))


def match(sets: DataFrame, rules: DataFrame, classed: DataFrame | None = None) -> DataFrame:
    """tokens, confidence: distinct token sets that some rule fits, with the surest rule's confidence.

    With ``classed`` the rules are of classes, else of tokens.
    """
    distinct = sets.select("tokens").distinct()
    if classed is None:
        classed = rules.select(F.explode("items").alias("token")).distinct().select("token", F.col("token").alias("cls"))
    else:
        classed = classed.join(rules.select(F.explode("items").alias("cls")).distinct(), "cls", "left_semi").select("token", "cls")
    known = in_classes(distinct, classed, "tokens")
    spread = known.select("tokens", F.col("items").alias("has"), F.explode("items").alias("item"))
    common = spread.groupBy("item").count()
    filed = rules.select("items", "confidence", F.explode("items").alias("item")).join(common, "item", "left").groupBy("items", "confidence").agg(
        F.min_by("item", F.struct(F.coalesce("count", F.lit(0)), "item")).alias("item"))
    return spread.join(filed, "item").where(F.size(F.array_except("items", "has")) == 0).groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def fixed_rule(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as struct(length, rule, verdict); null if none does."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, rule_host, rule_path in rules:
        by_host.setdefault(rule_host, []).append((rule_path, verdict))
    filed = F.create_map(*[x for k, v in by_host.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(k + a).alias("rule"), F.lit(a).alias("path"), F.lit(b).alias("verdict")) for a, b in v]))])
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(filed, s)), lambda r: r.isNotNull()))
    fits = F.filter(found, lambda r: F.startswith(p, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]],
          min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, path, rule, verdict for every page (page_id, url).

    ``labels`` (page_id, blocked) covers some pages; fixed rules go before mined ones.
    """
    said = pages.select("page_id", "url").withColumn("tokens", tokens(F.col("url")))
    told = labels.groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    labelled = storage.materialize(said.select("page_id", "tokens").join(told, "page_id").where(F.size("tokens") > 0), "labelled-pages")
    least = least_pages(labelled, min_support, min_pages)
    classed = storage.materialize(classes(labelled, least), "token-classes")
    mined = storage.materialize(mine_classes(labelled, classed, least, min_confidence), "url-rules")
    fits = match(said, mined, classed)
    out = said.join(fits, "tokens", "left").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    mined_says = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", mined_says).alias("verdict"))
