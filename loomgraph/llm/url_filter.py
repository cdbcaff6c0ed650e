"""URL filter: hand-written host/path rules first, mined association rules for the rest.

The longest fitting hand-written rule decides. Urls decided so are the labelled transactions of Spark's FP-growth:
the url's tokens (scheme; top-level domain, domain and every further host label; every path segment, digits as one sign; extension; every query key and
value; fragment), plus its verdict. Tokens of over 64 characters count by a digest of the whole. Association rules whose
consequent is a verdict are pruned by support and confidence and matched through an inverted index: each rule hangs
on its rarest token, urls meet it by joining on that token, and a rule fires if the url has all of its tokens.
The surest rule gives the verdict (confidence, then support, then `block` before `allow`); without one it is `allow`.

Before mining, tokens below the least support go (no rule can hold them), and tokens that occur in exactly the same labelled urls become one item, so that what
always comes together does not multiply item sets; a url has the item if it has any of its tokens. The tokens that are left number at most
the mean tokens of a url over the least support, whatever the table's size; this table is what is broadcast.
Null urls and urls without `://` have empty host and path and get the default. Rows are judged each for itself, repeated ones alike; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .license_scan import LOWER, UPPER

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.8
DEFAULT = "allow"


def split_url(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lowered), path and, for `tokens`, what follows the path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.locate("://", url)
    pages = pages.withColumn("_loom_rest", F.when(at > 0, F.substr(url, at + 3)).otherwise(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract("_loom_rest", "^([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract("_loom_rest", "^[^/?#]*([^?#]*)", 1),
        "_loom_tail": F.regexp_extract("_loom_rest", "^[^?#]*((?s).*)$", 1),
    }).drop("_loom_rest")


def apply_rules(pages: DataFrame, rules=RULES, verdict_col: str = "rule_verdict") -> DataFrame:
    """Adds rule and `verdict_col`, the rule's verdict, of the longest rule that fits host and path."""
    verdict, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        verdict, rule = F.when(fits, F.lit(what)).otherwise(verdict), F.when(fits, F.lit(host + path)).otherwise(rule)
    return pages.withColumn("rule", rule).withColumn(verdict_col, verdict)


def tokens(pages: DataFrame, url_col: str = "url", items_col: str = "items") -> DataFrame:
    """Adds `items_col` array<string>, the distinct tokens, to what `split_url` gave."""
    parts = lambda text, by: F.filter(F.split(text, by), lambda x: x != "")
    shape = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    short = lambda x: F.when(F.length(x) > 64, F.concat(F.lit("~"), F.md5(x))).otherwise(x)
    named = lambda name, x: F.concat(F.lit(name + "="), short(x))
    n = F.size("_loom_labels")
    query = F.regexp_extract("_loom_tail", "^\\?([^#]*)", 1)
    pages = pages.withColumns({"_loom_labels": parts("host", "\\."), "_loom_segments": parts("path", "/"), "_loom_query": parts(query, "[&;]")})
    one = lambda name, x: F.when(x.isNotNull() & (x != ""), named(name, x))
    singles = F.array(
        one("scheme", F.when(F.col("host") != "", F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "^([^:/?#]*)://", 1)))),
        one("top", F.get("_loom_labels", n - 1)), one("domain", F.get("_loom_labels", n - 2)),
        one("ext", F.regexp_extract(F.element_at(F.concat(F.array(F.lit("")), F.col("_loom_segments")), -1), "\\.([A-Za-z0-9]+)$", 1)),
        F.when(F.contains(F.col("_loom_tail"), F.lit("#")), F.lit("fragment")),
    )
    subs = F.transform(F.when(n > 2, F.slice("_loom_labels", F.lit(1), n - 2)).otherwise(F.array().cast("array<string>")), lambda x: named("sub", x))
    paths = F.transform("_loom_segments", lambda x: named("path", shape(x)))
    keys = F.transform("_loom_query", lambda x: named("key", F.regexp_extract(x, "^([^=]*)", 1)))
    values = F.transform(F.filter("_loom_query", lambda x: F.contains(x, F.lit("="))), lambda x: named("value", shape(F.regexp_extract(x, "=((?s).*)$", 1))))
    items = F.array_distinct(F.array_compact(F.concat(singles, subs, paths, keys, values)))
    return pages.withColumn(items_col, items).drop("_loom_labels", "_loom_segments", "_loom_query", "_loom_tail")


def item_of_token(labelled: DataFrame, min_support: float) -> dict[str, str]:
    """`labelled(items, row)`: frequent token -> its item, the least of the tokens that occur in exactly the same rows."""
    least = min_support * labelled.count()
    seen = labelled.select("row", F.explode("items").alias("token")).groupBy("token")
    marks = [F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"m{i}") for i in (1, 2)]
    kept = seen.agg(F.count("*").alias("n"), *marks).where(F.col("n") >= least).toArrow()  # mean tokens / min_support at most
    first: dict[tuple, str] = {}
    rows = sorted(zip(kept.column("token").to_pylist(), *[kept.column(c).to_pylist() for c in ("n", "m1", "m2")]))
    return {token: first.setdefault(tuple(mark), token) for token, *mark in rows}


def _as_items(df: DataFrame, known: dict[str, str], items_col: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("array<string>")
    def items(tokens: pd.Series) -> pd.Series:
        get = shared.value.get
        return tokens.map(lambda ts: sorted({i for t in ts if (i := get(t)) is not None}))

    return df.withColumn(items_col, items(F.col(items_col)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """`labelled(items, verdict)` -> rules: parts array<string>, anchor, verdict, confidence, support."""
    baskets = labelled.select(F.concat("items", F.array(F.concat(F.lit("@"), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    rules = model.associationRules.where(F.col("consequent")[0].startswith("@") & ~F.exists("antecedent", lambda x: x.startswith("@")))
    rules = materialize(rules.select("antecedent", F.substring(F.col("consequent")[0], 2, 16).alias("verdict"), "confidence", "support"), "url-rules")
    parts = rules.select("*", F.explode("antecedent").alias("item")).join(single, "item")
    return materialize(
        parts.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("freq", "item"))["item"].alias("anchor")).withColumnRenamed("antecedent", "parts"), "url-index"
    )


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """`pages` with host, path, rule, verdict and confidence (of the mined rule, null where none was used).

    Columns of `pages` so named, in any case of letters, are replaced; all others are kept as they are.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "confidence")
    seen = tokens(apply_rules(split_url(pages, url_col), rules, "_loom_verdict"), url_col, "_loom_items")
    labelled = seen.where("rule is not null").select(F.monotonically_increasing_id().alias("row"), F.col("_loom_items").alias("items"), F.col("_loom_verdict").alias("verdict"))
    labelled = materialize(labelled, "url-labelled")
    known = item_of_token(labelled, min_support)
    index = mine(_as_items(labelled, known, "items"), min_support, min_confidence)
    seen = _as_items(seen, known, "_loom_items")
    kinds = seen.where("rule is null and host <> ''").select(F.col("_loom_items").alias("items")).distinct()
    met = kinds.select("items", F.explode("items").alias("anchor")).join(index, "anchor")
    fired = met.where(F.size(F.array_except("parts", "items")) == 0)
    best = fired.groupBy("items").agg(F.max(F.struct("confidence", "support", "verdict")).alias("_loom_best"))
    out = seen.join(best.withColumnRenamed("items", "_loom_items"), "_loom_items", "left")
    verdict = F.coalesce("_loom_verdict", F.when(F.col("rule").isNull(), F.col("_loom_best.verdict")), F.lit(DEFAULT))
    confidence = F.when(F.col("rule").isNull(), F.col("_loom_best.confidence"))
    return out.select(*[out[c] for c in pages.columns], "host", "path", "rule", verdict.alias("verdict"), confidence.alias("confidence"))
