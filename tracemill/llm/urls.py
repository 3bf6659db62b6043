"""URL verdicts: explicit rules by host and path, then association rules mined by FP-growth.

A URL becomes a set of tokens: the labels and suffixes of its host, the parts of its path, its
scheme and the names in its query. Spark's FP-growth mines sets of tokens together with the label
of their page; rules that end in the bad label, with enough support and confidence, are kept, and
of these only those that no shorter kept rule with at least their confidence is part of. Rules
are matched by an inverted index: tokens of a URL meet the tokens of rules, and a rule applies
when as many tokens met as it has. Everything is DataFrame functions and Spark's own mining.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.session import written

#: Fixed values: (verdict, host, path); the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Least share of labelled pages that hold a set, and least number of them, least confidence of a rule, and its gain over
#: the share of bad pages.
SUPPORT, LEAST_PAGES, CONFIDENCE, LIFT = 0.002, 8, 0.5, 1.5
#: Deviations by which a rule's rate of bad pages has to lie above the base rate on the labelled pages it was not mined from.
DEVIATIONS = 3.0
#: The item that stands for the bad label; no token starts with a tab.
BAD = "\tbad"


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, 2_147_483_647))
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, 2_147_483_647))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, of the first among equals; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [
        F.when(
            ((host == r_host) | F.endswith(host, F.lit("." + r_host))) & F.startswith(path, F.lit(r_path)),
            F.struct(F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, r_host, r_path in ordered
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens_of(url: Column) -> Column:
    """Distinct tokens: ``h:`` labels of the host, ``d:`` its last two labels, ``p:`` words of the path, ``s:`` scheme, ``q:`` names in the query.

    Numbers count as one word, so a page number does not become a token of its own.
    """
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)

    def marked(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))

    words = F.split(F.regexp_replace(F.lower(path), r"[0-9]+", "0"), r"[/._-]+")
    found = F.concat(
        marked("h", labels), marked("d", F.array(F.substring_index(host, ".", -2))), marked("p", words),
        marked("s", F.array(F.lower(F.substring_index(url, "://", 1)))), marked("q", F.split(F.regexp_replace(query, r"=[^&]*", ""), "&")),
    )
    return F.array_distinct(F.when(F.instr(url, "://") > 0, found).otherwise(F.array().cast("array<string>")))


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """(rule, tokens, confidence): pruned rules from tokens to the bad label.

    pages has (page_id, url); labels has (doc_id, quality, toxic) for the pages of the same ids. A
    page is bad with quality 0 or toxic 1. Rules are mined from one half of the labelled pages, by
    a hash of the id, and have to hold on the other: the lower Wilson bound of their rate of bad
    pages there has to lie above the rate of all. So no rule stays where tokens tell nothing.
    """
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    known = labels.groupBy(F.col("doc_id").alias("page_id")).agg(bad)
    half = F.crc32(F.col("page_id").cast("string").cast("binary")) % 2 == 0
    known = pages.join(known, "page_id").select("bad", half.alias("half"), tokens_of(F.col("url")).alias("tokens")).where("size(tokens) > 0")
    known = written(known.withColumn("key", F.monotonically_increasing_id()), "url-labels")
    taught = known.where("half").select(F.when(F.col("bad") == 1, F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    empty = pages.sparkSession.createDataFrame([], "rule string, tokens array<string>, confidence double")
    pages_taught = taught.count()
    if not pages_taught:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, LEAST_PAGES / pages_taught)), minConfidence=confidence).fit(taught)
    rules = model.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= lift))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), "confidence")
    # A rule is pruned when one of its one-token-shorter parts is a rule of at least its confidence;
    # longer chains end there too, as confidence only falls along them.
    parts = rules.select("tokens", F.col("confidence").alias("c"), F.explode("tokens").alias("left_out"))
    parts = parts.select(F.col("tokens").alias("whole"), "c", F.array_sort(F.array_remove("tokens", F.col("left_out"))).alias("tokens"))
    pruned = parts.join(rules, "tokens").where("confidence >= c").select(F.col("whole").alias("tokens")).distinct()
    kept = rules.join(pruned, "tokens", "left_anti").select(F.array_join("tokens", " ").alias("rule"), "tokens", "confidence")
    return holding(written(kept, "url-rules"), known.where("NOT half"))


def holding(rules: DataFrame, pages: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """The rules whose rate of bad pages, by its lower Wilson bound, lies above that of all the pages (key, tokens, bad)."""
    base = pages.agg(F.avg("bad").alias("base")).scalar()
    found = posted(pages.select("key", "tokens"), rules).join(pages.select("key", "bad"), "key")
    rates = found.groupBy("rule").agg(F.count("*").alias("n"), F.avg("bad").alias("p"))
    z = F.lit(deviations)
    low = (F.col("p") + z * z / (2 * F.col("n")) - z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    return rules.join(rates.where(low > base).select("rule"), "rule", "left_semi").select("rule", "tokens", "confidence")


def posted(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule, confidence) of URLs (key, tokens) that hold all tokens of a rule, through an inverted index of the rules.

    A token of most URLs would meet all rules in one task, so each rule is first looked up by its
    rarest token only; the rest of its tokens is compared on the spot.
    """
    frequency = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("f"))
    listed = rules.select("rule", "tokens", "confidence", F.explode("tokens").alias("token")).join(frequency, "token")
    index = listed.groupBy("rule").agg(F.min(F.struct("f", "token"))["token"].alias("token"), F.first("tokens").alias("needed"), F.first("confidence").alias("confidence"))
    met = urls.select("key", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return met.where(F.size(F.array_intersect("tokens", "needed")) == F.size("needed")).select("key", "rule", "confidence")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, n_rules, confidence) of the URLs that a rule applies to."""
    return posted(urls, rules).groupBy("key").agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"))


def judge(
    pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id",
    support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_mined, mined_confidence) per row of pages.

    An explicit rule decides; else a page is blocked when a mined rule applies to its URL.
    Defined cases: a null URL, or one without ``://``, has an empty host and path, no tokens, and
    is allowed; a null id keeps its row; repeated rows are judged each; without labels nothing is
    mined; an empty table gives no rows. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    mined = mine(rows, labels.select(F.col(label_id_col).alias("doc_id"), "quality", "toxic"), support, confidence, lift)
    # Equal URLs are judged once.
    urls = rows.where("url IS NOT NULL").select("url").distinct()
    met = matches(urls.select(F.col("url").alias("key"), tokens_of(F.col("url")).alias("tokens")), mined)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = rows.join(met.withColumnRenamed("key", "url"), "url", "left").select("page_id", host.alias("host"), path.alias("path"), "n_rules", "confidence")
    out = out.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    by_rules = F.when(F.col("n_rules").isNotNull(), "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_rules).alias("verdict"),
        F.coalesce("n_rules", F.lit(0)).alias("n_mined"), F.col("confidence").alias("mined_confidence"),
    )
