"""URL verdicts from host and path rules and, beside them, a list of URLs behind a blocked Bloom filter.

The filter is a table of blocks of 256 bits.  A URL's hash names one block and six bits of
it, so a probe is a lookup of one block and never of more.  Blocks are built by a combinable
``bit_or`` and number at most ``MAX_BLOCKS``, which bounds what is broadcast: a longer list only
lets more URLs through to the exact join, which decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 15  # 32 bytes each, so 1 MB of filter
URLS_PER_BLOCK = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # verdict, host, path


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased), path and canonical URL; a URL without ``://`` has empty parts and no canonical form."""
    df = pages.withColumn("_rest", F.coalesce(_after_scheme(F.col("url")), F.lit("")))
    df = df.withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    df = df.withColumn("_tail", F.expr("substring(_rest, length(_host) + 1)"))
    df = df.withColumns({"host": F.translate("_host", UPPER, LOWER), "path": F.regexp_extract("_tail", "^[^?#]*", 0),
                         "_query": F.regexp_extract("_tail", r"^[^?#]*\?([^#]*)", 1)})
    # One page, many spellings: scheme, www., a closing slash, fragments and tracking parameters don't count.
    params = F.array_join(F.array_sort(F.filter(F.split("_query", "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    name = F.regexp_replace("host", "^www\\.", "")
    canon = F.concat(name, F.regexp_replace("path", "/$", ""), F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""))
    return df.withColumn("canonical", F.when(F.col("host") != "", canon)).drop("_rest", "_host", "_tail", "_query")


def rule_of(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits host and path, else NULLs."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text = F.when(fits, F.lit(host + path)).otherwise(text)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def _probe(blocks: int) -> list[Column]:
    """Block number and the four words of bits that a canonical URL sets there."""
    bit = [F.shiftright(F.xxhash64("canonical", F.lit(1)), 8 * j).bitwiseAND(255).cast("int") for j in range(6)]
    words = []
    for w in range(4):
        mask = F.lit(0).cast("long")
        for b in bit:
            mask = mask.bitwiseOR(F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(63))).otherwise(F.lit(0).cast("long")))
        words.append(mask.alias(f"_m{w}"))
    return [F.xxhash64("canonical").bitwiseAND(blocks - 1).alias("_block"), *words]


def bloom_blocks(listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """The filter of a table of ``canonical`` URLs: (its rows, number of blocks)."""
    need = max(1, listed.count() // URLS_PER_BLOCK)
    blocks = min(max_blocks, 1 << (need - 1).bit_length())
    return listed.select(*_probe(blocks)).groupBy("_block").agg(*[F.bit_or(f"_m{w}").alias(f"_w{w}") for w in range(4)]), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url; more columns are ignored).

    ``listed`` holds ``url`` values to block; they count in canonical form, repeats once.  The
    longest fitting rule decides; without one, a listed URL is blocked and any other allowed.
    NULL URLs and URLs without ``://`` have empty parts, fit no rule and are never listed.
    """
    names = with_parts(listed.select("url")).filter("canonical IS NOT NULL").select("canonical").distinct()
    filled, blocks = bloom_blocks(names, max_blocks)
    rule, verdict = rule_of(rules)
    rows = with_parts(pages.select("page_id", "url")).select("page_id", "host", "path", "canonical", rule.alias("rule"), verdict.alias("_ruled"), *_probe(blocks))
    seen = rows.join(F.broadcast(filled), "_block", "left")
    hit = F.lit(True)
    for w in range(4):
        hit = hit & (F.col(f"_w{w}").bitwiseAND(F.col(f"_m{w}")) == F.col(f"_m{w}"))
    hit = F.coalesce(hit & F.col("canonical").isNotNull(), F.lit(False))
    keep = ["page_id", "host", "path", "rule", "_ruled", "canonical"]
    # Only what the filter lets through meets the exact join; the rest moves nowhere.
    checked = seen.filter(hit).select(*keep).join(names.withColumn("_listed", F.lit(True)), "canonical", "left")
    rest = seen.filter(~hit).select(*keep).withColumn("_listed", F.lit(None).cast("boolean"))
    out = checked.select(*keep, "_listed").unionByName(rest)
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("_ruled", F.when(F.coalesce("_listed", F.lit(False)), "block").otherwise("allow")).alias("verdict"))
