"""URL filters: rules by host and path, then a list of canonical URLs.

The list may be large, so it is not sent around: a blocked Bloom filter of it is. One
64-bit hash picks a block of 512 bits, a second one PROBES bits inside that block. URLs that
pass are joined with the list itself, which removes the false positives; only those few are
shuffled. The filter has BITS_PER_KEY bits a key and never more than MAX_BITS (16 MB); a list
beyond that gets a fuller filter, more passing rows, and the same result.

Defined cases: a null URL, or one without `://`, has an empty host and path and no canonical
form, so it is allowed. Repeated list entries and repeated pages are harmless. An empty list
blocks nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
MAX_BITS = 1 << 27
BLOCK_BITS = 512
PROBES = 6
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"

ORDERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(value: Column) -> Column:
    return F.translate(value, ORDERED, ORDERED.lower())


def _rest(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    return F.when(url.contains("://"), F.regexp_replace(url, "^(?s).*?://", ""))


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.`, path without trailing slashes, query sorted and without tracking
    parameters; no scheme, no fragment. Null where there is no `://`."""
    query = F.regexp_extract(F.regexp_replace(_rest(url), "(?s)#.*$", ""), r"(?s)^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(
        url.contains("://"),
        F.concat(
            F.regexp_replace(host(url), r"^www\.", ""),
            F.regexp_replace(path(url), "/+$", ""),
            F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
        ),
    )


def rule_of(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host, path start, verdict) that fits, as a struct, or null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host_ == rule_host) | host_.endswith(f".{rule_host}")) & path_.startswith(start)
        value = F.struct(F.lit(rule_host + start).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, value).otherwise(best)
    return best


def _places(first: Column, second: Column, blocks: int) -> tuple[Column, list[Column]]:
    block = F.pmod(first, F.lit(blocks))
    bits = [F.shiftrightunsigned(second, 9 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)) for k in range(PROBES)]
    return block, bits


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


class BlockedBloom:
    """The filter's words of 64 bits, BLOCK_BITS / 64 per block."""

    def __init__(self, keys: DataFrame):
        """keys: one string column. The driver gets the filter's filled words, at most MAX_BITS."""
        name = keys.columns[0]
        distinct = keys.where(F.col(name).isNotNull()).distinct()
        self.blocks = max(1, min(distinct.count() * BITS_PER_KEY, MAX_BITS) // BLOCK_BITS + 1)
        block, bits = _places(*_hashes(F.col(name)), self.blocks)
        rows = (
            distinct.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
            .select(
                (F.col("block") * (BLOCK_BITS // 64) + F.expr("bit div 64")).alias("word"),
                F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("mask"),
            )
            .groupBy("word")
            .agg(F.bit_or("mask").alias("mask"))
        )
        self.words = np.zeros(self.blocks * (BLOCK_BITS // 64), np.int64)
        filled = rows.toArrow()
        self.words[filled["word"].to_numpy()] = filled["mask"].to_numpy()
        self.shared = keys.sparkSession.sparkContext.broadcast(self.words)

    def may_hold(self, key: Column) -> Column:
        """False only for keys that are not listed; null is not listed."""
        shared, blocks = self.shared, self.blocks

        @F.arrow_udf("boolean")
        def test(first: pa.Array, second: pa.Array) -> pa.Array:
            words, h1, h2 = shared.value, first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)
            start, found = (h1 % blocks) * (BLOCK_BITS // 64), np.ones(len(h1), bool)
            for k in range(PROBES):
                bit = (h2.view(np.uint64) >> np.uint64(9 * k)).astype(np.int64) & (BLOCK_BITS - 1)
                found &= (words[start + bit // 64] >> (bit % 64)) & 1 == 1
            return pa.array(found)

        first, second = _hashes(key)
        return key.isNotNull() & test(first, second)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, listed of every page.

    A rule decides where one fits; else a page is blocked if `listed` (one column of
    canonical URLs) holds its canonical URL.
    """
    listed = listed.select(F.col(listed.columns[0]).alias("entry"))
    bloom = BlockedBloom(listed)
    url = F.col("url")
    parts = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    tested = parts.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn(
        "maybe", bloom.may_hold(F.col("canonical"))
    )
    entries = listed.where(F.col("entry").isNotNull()).distinct()
    maybe = tested.where("maybe")
    exact = maybe.join(entries, maybe.canonical == entries.entry, "left").withColumn(
        "listed", F.col("entry").isNotNull()
    )
    rest = tested.where("not maybe").withColumn("listed", F.lit(False))
    return exact.drop("entry").unionByName(rest).select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "canonical",
        "listed",
    )
