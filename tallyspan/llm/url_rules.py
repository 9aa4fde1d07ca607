"""URL filters from association rules.

A url is a set of tokens: scheme, suffixes of the host, words of its subdomains, path words with
numbers made alike, query names, fragment. Labels come from two sources: the verdict of a given
domain rule, and, where none fits, the quality of the document that a page shows. Spark's
FP-growth mines token combinations together with their label.

- Tokens that always occur together are mined as one, and tokens without support are left out
  first, so that the number of combinations follows what is in the urls and not their length.
- A combination becomes a block rule when enough urls hold it (support) and the lower bound of
  the share of bad ones among them (Wilson, Z) reaches CONFIDENCE; where urls labelled by their
  document hold it too, the share among those, counted over all of them, has to reach CONFIDENCE
  as well, and its lower bound to exceed the usual share (a lift that is not chance), so that a given rule's verdicts do not spread to urls that speak against it.
- It becomes an allow rule, an exception, when the same holds for the good ones and it contains
  a block rule's tokens.
- A rule is dropped when leaving out one of its tokens gives a rule of its verdict as confident.

An inverted index matches them: each rule waits at its rarest token, so a url only meets the
rules of its own tokens; of those that fit, the longest wins, then the most confident. All rules
are used: the index is broadcast while it has at most BROADCAST_RULES rules, and joined by token
beyond.

Given domain rules (host, path) come first: a rule fits its host and all subdomains when the
path starts with the rule's; the longest wins. Only the suffixes of a url's host can name a
fitting rule, so a url looks up as many hosts as it has labels.

Defined results: a null url, or one without "://", has an empty host and path and no tokens
but these, and is allowed; repeated rows give equal results; without labelled urls there are
no mined rules; very long urls are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import keep, read

#: Least share of labelled urls that hold a rule's tokens together with its label, of LEAST_HITS
#: urls at least, and least share of those with its tokens that have its label.
SUPPORT = 0.002
CONFIDENCE = 0.6
LEAST_HITS = 10
#: Standard errors of the bound on a share.
Z = 2.0
#: About 200 bytes each.
BROADCAST_RULES = 20_000

DOMAIN_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(name: Column) -> Column:
    """a.b.c, b.c and c of the host a.b.c."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def tokens(url: Column, name: Column, where: Column) -> Column:
    """The distinct tokens of a url."""
    none = F.array().cast("array<string>")
    tagged = lambda tag, items: F.transform(items, lambda x: F.concat(F.lit(f"{tag}:"), x))
    words = F.filter(F.split(F.regexp_replace(F.lower(where), r"[0-9]+", "0"), r"[/._~-]+"), lambda x: x != "")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    labels = F.split(name, r"\.")
    above = F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0)))
    host_words = F.filter(F.flatten(F.transform(above, lambda x: F.split(x, "-"))), lambda x: x != "")
    some = [
        F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
        tagged("host", F.filter(suffixes(name), lambda x: x.contains("."))),
        F.array(F.concat(F.lit("end:"), F.element_at(labels, -1))),
        tagged("label", host_words),
        tagged("path", words),
        tagged("query", names),
        F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(none),
        F.when(where.endswith("/") & (F.length(where) > 1), F.array(F.lit("slash"))).otherwise(none),
    ]
    return F.when(name == "", none).otherwise(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in some])))


def lower_bound(hits: Column, n: Column, z: float = Z) -> Column:
    """Wilson's lower bound of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def merged_tokens(labelled: DataFrame, least: float) -> DataFrame:
    """token and its name: the least of the tokens that occur in the same rows of labelled (url,
    items), told by 128 bits of hashes; only tokens in `least` rows at least. Their number is
    bounded by the mean of a url's tokens over the support."""
    each = labelled.select(F.xxhash64("row").alias("x"), F.xxhash64("row", F.lit(1)).alias("y"), F.explode("items").alias("token"))
    found = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where(F.col("n") >= least)
    return found.groupBy("n", "x", "y").agg(F.min("token").alias("name"), F.collect_list("token").alias("tokens")).select("name", F.explode("tokens").alias("token"))


RULES = "antecedent array<string>, verdict string, confidence double, support double, hits long"


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, partitions: int | None = None) -> DataFrame:
    """antecedent (sorted tokens), verdict, confidence, support and hits of the rules that
    labelled (items array<string>, bad boolean, document boolean: whether its document labels
    it) shows. Labels are items of the transactions; a combination's counts are those of itself
    with each mark."""
    spark = labelled.sparkSession
    total = labelled.count()
    if not total:
        return spark.createDataFrame([], RULES)
    least = max(support, LEAST_HITS / total)
    if least > 1:
        return spark.createDataFrame([], RULES)
    rows = keep(labelled.withColumn("row", F.monotonically_increasing_id()), "labelled-rows")
    names = keep(merged_tokens(rows, least * total), "url-tokens")
    held = rows.select("row", F.explode("items").alias("token")).join(names, "token").groupBy("row").agg(F.collect_set("name").alias("names"))
    rows = keep(rows.select("row", "bad", "document").join(held, "row"), "named-rows")
    mark = F.when(F.col("bad"), "!bad").otherwise("!good")
    grown = FPGrowth(itemsCol="items", minSupport=least, numPartitions=partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(rows.select(F.concat("names", F.array(mark)).alias("items")))
    tokens_of, mark_of = F.filter("items", lambda x: ~x.startswith("!")), F.array_join(F.filter("items", lambda x: x.startswith("!")), "")
    sets = grown.freqItemsets.select(F.array_sort(tokens_of).alias("names"), mark_of.alias("mark"), "freq").where(F.size("names") > 0)
    n = lambda mark: F.coalesce(F.max(F.when(F.col("mark") == mark, F.col("freq"))), F.lit(0))
    counts = keep(sets.groupBy("names").agg(n("").alias("n"), n("!bad").alias("bad"), n("!good").alias("good")), "itemsets")
    likely = [counts.where((F.col(hits) > 0) & (lower_bound(F.col(hits), F.col("n")) >= confidence)).select("names", F.lit(verdict).alias("verdict"), F.col(hits).alias("hits"), "n") for hits, verdict in (("bad", "block"), ("good", "allow"))]
    likely = keep(likely[0].unionByName(likely[1]), "likely-rules")
    # what the urls labelled by their documents say about each of them, counted over all such urls
    often = frequencies(rows.select(F.col("names").alias("items")))
    spoken = fitting(rows.where("document").select("row", "bad", F.col("names").alias("items")), likely.select(F.col("names").alias("antecedent"), "verdict", F.lit(0.0).alias("confidence")), often)
    spoken = spoken.groupBy(F.col("r.antecedent").alias("names"), F.col("r.verdict").alias("verdict")).agg(F.count("*").alias("said"), F.count_if(F.col("bad") == (F.col("r.verdict") == "block")).alias("agree"))
    base = rows.where("document").agg(F.coalesce(F.avg(F.col("bad").cast("double")), F.lit(0.0)).alias("b")).first()["b"]
    usual = F.when(F.col("verdict") == "block", base).otherwise(1 - base)
    agreed = (F.col("agree") >= confidence * F.col("said")) & (lower_bound(F.col("agree"), F.col("said")) > usual)
    sure = keep(likely.join(spoken, ["names", "verdict"], "left").where(F.col("said").isNull() | agreed), "sure-rules")

    def pruned(found: DataFrame) -> DataFrame:
        smaller = found.select("names", "confidence", F.explode("names").alias("out")).select(F.col("names").alias("whole"), F.col("confidence").alias("own"), F.array_remove("names", F.col("out")).alias("names"))
        redundant = smaller.join(found.select("names", "confidence"), "names").where(F.col("confidence") >= F.col("own")).select(F.col("whole").alias("names")).distinct()
        return found.join(redundant, "names", "left_anti")

    sure = sure.select("names", "verdict", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / total).alias("support"), "hits")
    block = keep(pruned(sure.where("verdict = 'block'")), "block-rules")
    # a block rule waits at one of its tokens; an exception holds all tokens of one
    waiting = block.select(F.col("names").alias("inner"), F.get("names", F.lit(0)).alias("name"))
    allow = sure.where("verdict = 'allow'")
    inside = allow.select("names", F.explode("names").alias("name")).join(waiting, "name").where(F.size(F.array_except("inner", "names")) == 0).select("names").distinct()
    every = keep(block.unionByName(pruned(keep(allow.join(inside, "names", "left_semi"), "exceptions"))), "rules")
    whole = every.select("names", F.explode("names").alias("name")).join(names, "name").groupBy("names").agg(F.sort_array(F.collect_set("token")).alias("antecedent"))
    return every.join(whole, "names").select("antecedent", "verdict", "confidence", "support", "hits")


def index(rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """token, rules: every mined rule at the token of its antecedent that is rarest."""
    each = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("token")).join(frequency, "token", "left")
    rarest = each.groupBy("antecedent", "verdict", "confidence").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    rule = F.struct(F.size("antecedent").alias("size"), "confidence", "verdict", "antecedent")
    return rarest.groupBy("token").agg(F.collect_list(rule).alias("rules"))


def fitting(urls: DataFrame, rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """Rows of urls (items and others) with r (size, confidence, verdict, antecedent) of every
    rule that fits. Only rows that hold a rule's rarest token come out of the join."""
    waiting = keep(index(rules, frequency), "url-rule-index")
    if rules.count() <= BROADCAST_RULES:
        waiting = F.broadcast(waiting)
    met = urls.withColumn("token", F.explode("items")).join(waiting, "token").select(*urls.columns, F.explode("rules").alias("r"))
    return met.where(F.size(F.array_except("r.antecedent", "items")) == 0)


def matched(urls: DataFrame, rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """url and r, the rule that wins, of the distinct urls (url, items) that a rule fits."""
    return fitting(urls.select("url", "items").distinct(), rules, frequency).groupBy("url").agg(F.max("r").alias("r"))


def frequencies(labelled: DataFrame) -> DataFrame:
    return labelled.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def labels_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels of pages: a page's url ends in the number of the document that it shows.
    A page is bad when its document is of low quality or toxic."""
    number = F.regexp_extract(path(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    bad = labels.groupBy(F.col("doc_id").alias("_doc")).agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    return pages.withColumn("_doc", F.when(number != "", number.cast("long"))).join(bad, "_doc").drop("_doc")


def labelled_urls(pages: DataFrame, labels: DataFrame, domain_rules=DOMAIN_RULES) -> tuple[DataFrame, DataFrame]:
    """(pages with host, path, items, rule and given; url, items, bad, document of the labelled
    ones: by the given rule that fits, else by their document)."""
    url = F.col("url")
    split = pages.select("page_id", url).withColumn("host", host(url)).withColumn("path", path(url))
    named = _verdict(split, domain_rules).withColumn("items", tokens(url, F.col("host"), F.col("path")))
    given = named.where("given IS NOT NULL").select("url", "items", (F.col("given") == "block").alias("bad"), F.lit(False).alias("document"))
    shown = labels_of(named.where("given IS NULL"), labels).select("url", "items", "bad", F.lit(True).alias("document"))
    return named, given.unionByName(shown)


def judge(pages: DataFrame, labels: DataFrame, domain_rules=DOMAIN_RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict, mined (the antecedent of the mined
    rule that fits, else null), mined_verdict and its confidence."""
    named, labelled = labelled_urls(pages, labels, domain_rules)
    labelled = keep(labelled.select("items", "bad", "document"), "labelled-urls")
    mined = keep(mine(labelled, support, confidence), "url-rules")
    best = matched(named, mined, frequencies(labelled)).select(F.col("url").alias("_url"), F.col("r.antecedent").alias("mined"), F.col("r.verdict").alias("mined_verdict"), F.col("r.confidence").alias("confidence"))
    joined = named.join(best, F.col("url") == F.col("_url"), "left")
    return joined.select("page_id", "url", "host", "path", "rule", F.coalesce("given", "mined_verdict", F.lit("allow")).alias("verdict"), "mined", "mined_verdict", "confidence")


def held_out(pages: DataFrame, labels: DataFrame, domain_rules=DOMAIN_RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """document (whether the document labels the url), n, bad, caught and wrong: how the rules
    that four fifths of the labelled urls show judge the last fifth."""
    labelled = keep(labelled_urls(pages, labels, domain_rules)[1].withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(5))), "labelled-urls")
    train = labelled.where("fold > 0").select("items", "bad", "document")
    best = matched(labelled.where("fold = 0"), keep(mine(train, support, confidence), "url-rules"), frequencies(train))
    judged = labelled.where("fold = 0").join(best, "url", "left").withColumn("blocked", F.coalesce(F.col("r.verdict") == "block", F.lit(False)))
    return judged.groupBy("document").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.count_if(F.col("bad") & F.col("blocked")).alias("caught"), F.count_if(~F.col("bad") & F.col("blocked")).alias("wrong"))


def _verdict(split: DataFrame, domain_rules) -> DataFrame:
    """split with the longest fitting domain rule and its verdict, by lookup of each suffix
    of the host in a map of the rules, which are code, not data."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in domain_rules:
        name, _, rest = rule.partition("/")
        by_host.setdefault(name.lower(), []).append((f"/{rest}", rule, verdict))
    kind = "map<string,array<struct<path:string,rule:string,verdict:string>>>"
    pairs = [x for name, rules in by_host.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for p, r, v in rules]))]
    table = F.create_map(*pairs) if pairs else F.create_map().cast(kind)
    held = F.flatten(F.transform(suffixes(F.col("host")), lambda s: F.coalesce(F.try_element_at(table, s), F.array().cast(kind[11:-1]))))
    fitting = F.filter(held, lambda x: F.col("path").startswith(x["path"]))
    longest = F.array_max(F.transform(fitting, lambda x: F.struct(F.char_length(x["rule"]).alias("n"), x["rule"].alias("rule"), x["verdict"].alias("verdict"))))
    return split.withColumn("_best", longest).withColumns({"rule": F.col("_best.rule"), "given": F.col("_best.verdict")}).drop("_best")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))
    return rows.select("page_id", "host", "path", "rule", "verdict", F.array_join("mined", " ").alias("mined_rule"), "mined_verdict", "confidence")


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE_SQL: dict[str, str] = {}
