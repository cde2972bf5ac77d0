"""URL filters: fixed host and path rules, then association rules mined by FP-growth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import cut


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"://([^/?#]*)([^?#]*)"
#: Token sets with a mined rule up to this number are broadcast to the pages; more are joined by shuffle,
#: where both sides are exchanges of their own, so that Spark can split a token set that very many pages share.
BROADCAST_SETS = 10_000
#: The item that stands for an unwanted page; no token contains a space.
BLOCK = "is block"
#: Unwanted pages that a rule rests on at least, and the share of unwanted pages that its lower bound must reach.
MIN_PAGES = 20
MIN_CONFIDENCE = 0.6
#: Normal quantile of the lower bound (97.5 %).
Z = 1.96


def host(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting_rule(at: Column, below: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as struct (length, host_length, rule, verdict); null if none does."""
    null = F.lit(None).cast("struct<length:int,host_length:int,rule:string,verdict:string>")
    found = [
        F.when(
            ((at == r.host) | at.endswith("." + r.host)) & below.startswith(r.path),
            F.struct(F.lit(len(r.text)).alias("length"), F.lit(len(r.host)).alias("host_length"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")),
        ).otherwise(null)
        for r in rules
    ]
    return F.greatest(*found, null, null)


def tokens(url: Column) -> Column:
    """Sorted distinct tokens: the host, its labels, path segments and query keys; digits count as #."""
    at, below = host(url), path(url)
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), F.lit(""))

    def marked(mark: str, parts: Column) -> Column:
        clean = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.lower(p), r"[0-9]+", "#"), r"\s+", "_"))
        return F.transform(F.filter(clean, lambda p: p != ""), lambda p: F.concat(F.lit(mark), p))

    keys = F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, "^[^=]*", 0))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.when(at != "", F.array(F.concat(F.lit("host:"), at))).otherwise(F.array().cast("array<string>")),
                marked("label:", F.split(at, r"\.")),
                marked("path:", F.split(below, "/")),
                marked("key:", keys),
            )
        )
    )


def lower_bound(hits: Column, of: Column) -> Column:
    """Wilson's lower bound of a share of which `hits` of `of` were seen."""
    p, n = hits / of, of.cast("double")
    return (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def distinguishable(baskets: DataFrame) -> DataFrame:
    """(id, bad, items) with one item, the first, for those that come in exactly the same baskets (id, bad, items)."""
    each = baskets.select("id", F.explode("items").alias("item"))
    spread = F.xxhash64("id")
    same = each.groupBy("item").agg(F.count("*").alias("n"), F.bit_xor(spread).alias("xor"), F.sum(F.shiftrightunsigned(spread, 24)).alias("sum"))
    first = same.groupBy("n", "xor", "sum").agg(F.min("item").alias("item")).select("item")
    items = each.join(first, "item").groupBy("id").agg(F.collect_list("item").alias("items"))
    return baskets.select("id", "bad").join(items, "id")


def without(items: Column, prefix: str) -> Column:
    return F.filter(items, lambda x: ~x.startswith(prefix))


def mined_rules(labelled: DataFrame, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule, items, pages, bad_pages, confidence, lower): token combinations that imply an unwanted page.

    labelled has url and bad (boolean). FP-growth mines token combinations that at least min_pages
    unwanted pages have, an absolute number that means the same at every size. A rule stays if the
    lower bound of its confidence reaches min_confidence and the share of unwanted pages among all. A
    rule with a subset of another's items, at least as sure, makes the other superfluous, which is dropped.

    A host implies its labels, so combinations are mined once with hosts and once with labels. Tokens
    that always come together among the labelled pages are mined as one, the first of them.
    """
    spark = labelled.sparkSession
    found = cut(labelled.where(F.col("bad").isNotNull()).select("bad", tokens(F.col("url")).alias("items")))
    found = found.withColumn("id", F.monotonically_increasing_id())
    total, bad = found.agg(F.count("*"), F.count_if("bad")).first()
    if bad < max(1, min_pages):
        return spark.createDataFrame([], "rule string, items array<string>, pages long, bad_pages long, confidence double, lower double")
    found = cut(distinguishable(found))
    mark = F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    parts = []
    for left_out in ("label:", "host:"):
        baskets = cut(found.select(F.concat(without(F.col("items"), left_out), mark).alias("items")))
        # the half keeps rounding from asking for one page more
        model = FPGrowth(itemsCol="items", minSupport=(min_pages - 0.5) / total, minConfidence=min_confidence).fit(baskets)
        rows = baskets.count()
        rules = model.associationRules.where(F.array_contains("consequent", BLOCK) & (F.size("antecedent") > 0))
        hits = F.round(F.col("support") * rows).cast("long")
        parts.append(rules.select(F.array_sort("antecedent").alias("items"), F.round(hits / F.col("confidence")).cast("long").alias("pages"), hits.alias("bad_pages")))
    rules = parts[0].unionByName(parts[1]).distinct().withColumn("confidence", F.col("bad_pages") / F.col("pages")).withColumn("lower", lower_bound(F.col("bad_pages"), F.col("pages")))
    rules = cut(rules.where((F.col("lower") >= min_confidence) & (F.col("lower") > bad / total)).withColumn("rule", F.array_join("items", " ")))
    items = rules.select("rule", "lower", "items", F.explode("items").alias("item"))
    smaller = rules.select(F.col("items").alias("fewer"), F.col("lower").alias("surer"), F.col("items")[0].alias("item"))
    implied = items.join(smaller, "item").where((F.size(F.array_except("fewer", "items")) == 0) & (F.size("fewer") < F.size("items")) & (F.col("surer") >= F.col("lower")))
    return rules.join(implied.select("rule").distinct(), "rule", "left_anti").select("rule", "items", "pages", "bad_pages", "confidence", "lower")


def matched(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct token sets (items) that hold all items of some rule, with the surest rule.

    Inverted index: each rule is filed under its rarest item alone, among the rules' items; token
    sets meet the rules filed under their tokens, and then the other items are compared.
    """
    item = rules.select("rule", "items", "lower", "confidence", F.explode("items").alias("item"))
    often = item.groupBy("item").agg(F.count("*").alias("n"))
    index = item.join(often, "item").groupBy("rule", F.col("items").alias("rule_items"), "lower", "confidence").agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    sets = baskets.select("items").distinct().select("items", F.explode("items").alias("item"))
    hit = sets.join(index, "item").where(F.size(F.array_except("rule_items", "items")) == 0)
    surest = F.struct((-F.col("lower")).alias("order"), F.size("rule_items").alias("size"), "rule")
    return hit.groupBy("items").agg(F.min_by("rule", surest).alias("mined"), F.min_by("confidence", surest).alias("confidence"))


def judge(
    pages: DataFrame,
    labelled: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    min_pages: int = MIN_PAGES,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, mined, confidence.

    The longest fixed rule that fits decides; without one, a page is blocked if its tokens hold all
    items of a mined rule (mined tells the surest, ties to the one with fewer items, then the first),
    and allowed if not. A url that is null or has no :// has empty host and path; no rule fits it.
    Null ids and repeated rows are judged like any others. With fewer than min_pages unwanted pages
    nothing is mined; an empty table gives an empty result. Other columns of pages are not read. The
    fixed rules are literals of the plan, so they should be some hundreds at most.
    """
    own = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), tokens(F.col("url")).alias("items"))
    fixed = own.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    mined = cut(mined_rules(labelled, min_pages, min_confidence))
    if mined.limit(1).count():
        found = cut(matched(own, mined))
        if found.count() <= BROADCAST_SETS:
            found = F.broadcast(found)
        fixed = fixed.join(found, "items", "left")
    else:
        fixed = fixed.withColumns({"mined": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    return fixed.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "mined",
        "confidence",
    )


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of pages whose path has the number of a labelled document: bad if of low quality or toxic."""
    number = F.try_to_number(F.regexp_extract(path(F.col("url")), r"/([0-9]{1,15})(?:[./]|$)", 1), F.lit("999999999999999")).cast("long")
    known = labels.groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("bad"))
    return pages.select("url", number.alias("doc_id")).join(known, "doc_id").select("url", (F.col("bad") == 1).alias("bad"))


def _sql_tokens(url: str, at: str, below: str) -> str:
    clean = "list_transform(list_filter({parts}, lambda p: p <> ''), lambda p: '{mark}' || regexp_replace(regexp_replace(lower(p), '[0-9]+', '#', 'g'), '\\s+', '_', 'g'))"
    keys = f"list_transform(string_split(regexp_extract(coalesce({url}, ''), '://[^?#]*\\?([^#]*)', 1), '&'), lambda p: regexp_extract(p, '^[^=]*'))"
    lists = [f"CASE WHEN {at} <> '' THEN ['host:' || {at}] ELSE [] END", clean.format(parts=f"string_split({at}, '.')", mark="label:"), clean.format(parts=f"string_split({below}, '/')", mark="path:"), clean.format(parts=keys, mark="key:")]
    return f"list_distinct({' || '.join(lists)})"


_HOST = f"translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}')"
_PATH = f"regexp_extract(coalesce(url, ''), '{URL}', 2)"
_FITS = " UNION ALL ".join(
    f"SELECT n, '{r.text}' AS rule, '{r.verdict}' AS verdict FROM p WHERE (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in RULES
)

#: Every combination of each labelled page's tokens is counted, so this is for small tables. Rules
#: that a surer one with fewer items makes superfluous needn't be dropped, as they're never the surest.
ORACLE_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS n, page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages),
p AS (SELECT *, {_sql_tokens("url", "host", "path")} AS items FROM u),
known AS (SELECT doc_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) = 1 AS bad FROM labels GROUP BY doc_id),
b AS (SELECT n, bad, items FROM p JOIN known ON doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,15}})([./]|$)', 1) AS BIGINT)),
e AS (SELECT n, bad, unnest(items) AS item FROM b),
same AS (SELECT item, list_sort(list(n)) AS pages FROM e GROUP BY item),
first AS (SELECT min(item) AS item FROM same GROUP BY pages),
kept AS (SELECT n, bad, item, starts_with(item, 'host:') AS is_host, starts_with(item, 'label:') AS is_label FROM e JOIN first USING (item)),
views AS (
  SELECT n, any_value(bad) AS bad, list(item ORDER BY item) AS items FROM kept WHERE NOT is_label GROUP BY n UNION ALL
  SELECT n, any_value(bad), list(item ORDER BY item) FROM kept WHERE NOT is_host GROUP BY n),
masks AS (SELECT n, bad, items, unnest(range(1, (1 << len(items))::BIGINT)) AS mask FROM views),
sets AS (SELECT DISTINCT n, bad, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items FROM masks),
counts AS (SELECT items, count(*) AS pages, count_if(bad) AS bad_pages FROM sets GROUP BY items HAVING count_if(bad) >= {MIN_PAGES}),
share AS (SELECT *, bad_pages / pages AS c, pages::DOUBLE AS m FROM counts),
bound AS (SELECT *, (c + {Z * Z} / (2 * m) - {Z} * sqrt(c * (1 - c) / m + {Z * Z} / (4 * m * m))) / (1 + {Z * Z} / m) AS lower FROM share),
rules AS (SELECT items, c AS confidence, lower, array_to_string(items, ' ') AS rule FROM bound WHERE lower >= {MIN_CONFIDENCE} AND lower > (SELECT avg(bad::INT) FROM b)),
hits AS (SELECT n, arg_min(r.rule, (-lower, len(r.items), r.rule)) AS mined, arg_min(confidence, (-lower, len(r.items), r.rule)) AS confidence FROM p JOIN rules r ON list_has_all(p.items, r.items) GROUP BY n),
fits AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS fixed FROM ({_FITS}) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN mined IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, mined, confidence
FROM p LEFT JOIN fits USING (n) LEFT JOIN hits USING (n)
"""
