"""URL filtering: domain rules first, association rules for all other URLs.

Domain rules have a host and perhaps a path. A rule fits its host and all subdomains, if the URL's path starts with the
rule's; of the rules that fit, the longest decides. For the others, FP-growth mines combinations of URL tokens that go
with a blocking label. Rules that are rare, uncertain, no surer than chance or no better than a part of them are pruned.
Each rule is listed under its rarest token; a URL looks its tokens up there and is blocked if all tokens of a rule are its own.

Tokens that stand in exactly the same labelled URLs, such as all segments of one URL that was copied often, are one
item, and a rule on the item asks for all of them. FP-growth lists all subsets of a row's items, so it gets those that
are among the first ITEMS of every row that has them, those that tell most about the label first. Sets with any other
item, which only some long URLs have, are grown item by item over the rows that have them, and counted exactly: a set
is left alone when it is too rare for a rule, blocks always, or stands in the same rows as a part of it, as then no larger set makes a rule
that its parts do not make.

A null URL, or one without `://`, has an empty host and path and is allowed. Labels are 1 to block and 0 to allow;
null labels and URLs do not teach. Without labels, or without rules that pass, the association rules block nothing.
A URL is taken whole, however long. Of equally long domain rules that fit (one host and path), the first by verdict
decides. Repeated rows get equal results; an empty table gives an
empty result. Other columns of pages, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import dropped, stored

#: The token that stands for a blocking label among a URL's tokens; no URL token has this form.
BLOCK = "\0block"
#: What a rule needs: this share of the labelled URLs, this share of blocking labels among those that it fits, and at
#: least so many blocking labels.
SUPPORT, CONFIDENCE, LEAST = 0.002, 0.6, 5
#: A rule's confidence must be so far above the share of blocking labels among all that chance does this with a
#: probability of exp(-SURE) at most, by Chernoff's bound.
SURE = 10.0
#: Items of a row that FP-growth gets at most.
ITEMS = 12
#: Rows that may be broadcast: frequent tokens, and token sets that rules block.
BROADCAST_ROWS = 100_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domain_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, from (verdict, host, path) rules; null if none does."""
    fits = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r)):
        fit = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        fits.append(F.when(fit, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule: string, verdict: string>")


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host from its end, words of labels, and path segments with digits as 0."""
    labels = F.reverse(F.split(host, "\\."))
    named = F.transform(labels, lambda x, i: F.concat(F.lit("h"), F.least(i, F.lit(2)).cast("string"), F.lit(":"), x))
    words = F.transform(F.filter(F.split(host, "[.-]"), lambda x: x != ""), lambda x: F.concat(F.lit("w:"), x))
    segments = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda x: x != "")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(named, words, F.transform(segments, lambda x: F.concat(F.lit("p:"), x)))))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def labelled_items(labelled: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(row, items, label) of each row of (row, tokens, label), items being (item, late) in falling order of what they tell, and (item, tokens) of each item.

    An item is named by the first of its tokens, and late if it is behind the first ITEMS of any row. Tokens with fewer than
    `least` blocking labels are in no rule.
    """
    base = F.lit(labelled.agg(F.avg("label")).first()[0])
    each = labelled.select("row", "label", F.explode(F.array_distinct("tokens")).alias("token"))
    mark = F.xxhash64("row")
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("label").alias("blocks"), F.bit_xor(mark).alias("mark"), F.sum(mark.bitwiseAND(0xFFFFFFFF)).alias("sum")).where(F.col("blocks") >= least)
    items = seen.groupBy("n", "blocks", "mark", "sum").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    telling = F.abs(F.col("blocks") - F.col("n") * base) / F.sqrt(F.col("n"))
    items = stored(items.select(F.element_at("tokens", 1).alias("item"), "tokens", F.round(telling, 9).alias("telling")), "items")
    own = each.join(_few(items.select(F.col("item").alias("token"), "telling")), "token").groupBy("row").agg(F.array_sort(F.collect_list(F.struct((-F.col("telling")).alias("t"), "token"))).alias("own"))
    own = stored(own.select("row", F.col("own.token").alias("names")), "own")
    late = own.where(F.size("names") > ITEMS).select(F.explode(F.slice("names", ITEMS + 1, F.size("names"))).alias("item")).distinct().withColumn("late", F.lit(True))
    placed = own.select("row", F.posexplode("names").alias("place", "item")).join(_few(late), "item", "left")
    told = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "item", F.coalesce("late", F.lit(False)).alias("late")))).alias("items"))
    rows = labelled.select("row", "label").join(told.select("row", F.transform("items", lambda x: F.struct(x["item"].alias("item"), x["late"].alias("late"))).alias("items")), "row", "left")
    return rows.withColumn("items", F.coalesce("items", F.array().cast("array<struct<item: string, late: boolean>>"))), items.select("item", "tokens")


def grown_sets(rows: DataFrame, least: float) -> DataFrame | None:
    """(antecedent, n, blocks) of the sets with a late item that may make rules, from (row, items, label); None if no item is late.

    A set grows in one order, late items first and then by name, so that each is made once, from its first part.
    """
    each = rows.where(F.exists("items", lambda x: x["late"])).select("row", "label", F.explode("items").alias("i")).select("row", "label", F.struct((~F.col("i.late")).alias("core"), F.col("i.item").alias("item")).alias("last"))
    if not each.limit(1).count():
        return None
    each = stored(each, "each")
    held = each.where(~F.col("last.core")).withColumn("antecedent", F.array("last.item"))
    found, before = None, None
    while True:
        counted = held.groupBy("antecedent").agg(F.count("*").alias("n"), F.sum("label").alias("blocks")).where(F.col("blocks") >= least)
        if before is not None:
            # parts without a late item are FP-growth's and not looked at here, which leaves more to grow and no less
            part = before.select(F.col("antecedent").alias("part"), F.col("n").alias("part_n"))
            parts = counted.select("antecedent", "n", F.explode(F.transform("antecedent", lambda x: F.array_remove("antecedent", x))).alias("part"))
            same = parts.join(part, "part").where(F.col("n") == F.col("part_n")).select("antecedent").distinct()
            counted = counted.join(same, "antecedent", "left_anti")
        counted = stored(counted, "sets")
        if not counted.limit(1).count():
            return found
        found = counted if found is None else found.unionByName(counted)
        before = counted
        going = _few(counted.where("blocks < n").select("antecedent"))
        more = each.select("row", F.col("last").alias("next"))
        grown = held.join(going, "antecedent").join(more, "row").where("next > last")
        held = stored(grown.select("row", "label", F.col("next").alias("last"), F.concat("antecedent", F.array("next.item")).alias("antecedent")), "grown")


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, sure: float = SURE) -> DataFrame:
    """(tokens, confidence, support) of the rules that block, from (tokens, label)."""
    labelled = stored(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", F.col("label").cast("int").alias("label")), "labelled")
    total, blocked = labelled.agg(F.count("*"), F.sum("label")).first()
    schema = "tokens array<string>, confidence double, support double"
    if not blocked:
        return labelled.sparkSession.createDataFrame([], schema)
    needed = max(support * total, least)
    rows, items = labelled_items(labelled, needed)
    rows = stored(rows, "rows")
    core = F.transform(F.filter("items", lambda x: ~x["late"]), lambda x: x["item"])
    taught = stored(rows.select(F.when(F.col("label") == 1, F.concat(core, F.array(F.lit(BLOCK)))).otherwise(core).alias("items")), "taught")
    model = FPGrowth(itemsCol="items", minSupport=needed / total, minConfidence=confidence).fit(taught)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK)).select("antecedent", "confidence", "support")
    # so many blocking labels alone would have to be surer than chance
    grown = grown_sets(rows, max(needed, sure / -math.log(blocked / total)) if blocked < total else needed)
    if grown is not None:
        found = found.unionByName(grown.select("antecedent", (F.col("blocks") / F.col("n")).alias("confidence"), (F.col("blocks") / total).alias("support")).where(F.col("confidence") >= confidence))
    base, c = blocked / total, F.col("confidence")
    apart = F.when(c >= 1, -math.log(base)).otherwise(c * F.log(c / base) + (1 - c) * F.log((1 - c) / max(1 - base, 1e-300)))
    found = found.where((c >= base) & (F.col("support") * total / c * apart > sure))
    rules = stored(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "rules")
    dropped(taught)
    # a rule goes if a part of it is as certain: rules that share the part's first item are compared
    part = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"), F.col("tokens")[0].alias("first"))
    whole = rules.select("tokens", "confidence", F.explode("tokens").alias("first"))
    pruned = whole.join(part, "first").where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("part_confidence") >= F.col("confidence"))).select("tokens").distinct()
    left = rules.join(pruned, "tokens", "left_anti").withColumn("rule", F.monotonically_increasing_id())
    left = stored(left, "left")
    spelled = left.select("rule", F.explode("tokens").alias("item")).join(items, "item").groupBy("rule").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens"))
    return left.drop("tokens").join(spelled, "rule").select("tokens", "confidence", "support")


def rule_matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, confidence) of each URL that a rule fits, from (key, tokens): its most certain rule."""
    often = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    listed = rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(often, "token")
    index = listed.groupBy("tokens", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token")).withColumnRenamed("tokens", "wanted")
    asked = urls.select("key", "tokens", F.explode("tokens").alias("token"))
    hits = asked.join(index, "token").where(F.size(F.array_except("wanted", "tokens")) == 0)
    return hits.groupBy("key").agg(F.max("confidence").alias("confidence"))


def url_verdicts(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, confidence) of each row of pages; labels has (key, label).

    Equal URLs get equal verdicts: tokens are matched once for each distinct set of tokens.
    """
    df = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    df = stored(df.withColumn("tokens", url_tokens(F.col("host"), F.col("path"))).withColumn("fit", domain_rule(rules, F.col("host"), F.col("path"))), "urls")
    taught = df.where("size(tokens) > 0").join(labels.select(F.col(key).alias("key"), F.col("label").cast("int").alias("label")).where("label is not null and key is not null"), "key").select("tokens", "label")
    mined = stored(mined_rules(taught), "mined")
    asked = (F.col("fit").isNull() & (F.size("tokens") > 0)).alias("asked")
    if mined.limit(1).count():
        distinct = df.where(asked).select("tokens").distinct().select(F.col("tokens").alias("key"), "tokens")
        blocked = stored(rule_matches(distinct, mined).select(F.col("key").alias("tokens"), "confidence"), "blocked")
        out = df.where(asked).join(_few(blocked), "tokens", "left").unionByName(df.where(~asked).withColumn("confidence", F.lit(None).cast("double")))
    else:
        out = df.withColumn("confidence", F.lit(None).cast("double"))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "confidence")
