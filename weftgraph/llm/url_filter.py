"""URL filters: rules by host and path, then a list of canonical URLs.

All on the JVM: DataFrame functions only. The list is turned into a blocked
Bloom filter, a table (block, bits) of one 64-bit word per block. A page's
canonical URL names one block; only pages whose bits are all set there, the
possible hits, go to the exact hash join with the list, which removes the
false positives. Pages are read once. The filter and the list are broadcast only when a count has
shown them to be small; beyond that the same joins shuffle.

Defined results: a null URL, or one without ``://``, has empty host and path,
fits no rule and is never listed, so it is allowed; where several rules fit,
the longest wins, then the one with the longer host, then the later in code
point order; a very long URL is as any other; repeated rows each get their own verdict; an empty table gives an
empty result; an empty list blocks nothing; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stage

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: Broadcast up to so many filter blocks (16 bytes each) and so many bytes of list.
BROADCAST_BLOCKS = 1 << 19
BROADCAST_BYTES = 8 << 20
KEYS_PER_BLOCK = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substr(rest, F.length(raw) + 1)
    path = F.regexp_extract(after, r"^([^?#]*)", 1)
    return F.translate(raw, _UPPER, _LOWER), path, F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1)


def canonical(host: Column, path: Column, query: Column) -> Column:
    """One spelling for the variants of an address: no scheme, www or m host, index page, tracking argument or fragment."""
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(
        F.regexp_replace(host, r"^(www|m)\.", ""),
        F.regexp_replace(path, r"(/index\.html?|\.html?|/)+$", ""),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
    )


def with_parts(pages: DataFrame) -> DataFrame:
    host, path, query = parts(F.col("url"))
    return pages.select("page_id", host.alias("host"), path.alias("path"), query.alias("query")).select(
        "page_id", "host", "path", F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"), F.col("query"))).alias("canon")
    )


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The winning rule as struct(size, host_size, rule, verdict), else null."""
    if not rules:
        return F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in rules
    ]
    return F.array_max(F.array(*fits))


def _bits(canon: Column) -> Column:
    h = F.xxhash64(canon, F.lit(11))
    one = F.lit(1).cast("long")
    mask = F.lit(0).cast("long")
    for k in range(5):
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")))
    return mask


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, bits) of a column `canon`; its size is set by `n_blocks`."""
    return listed.groupBy(F.pmod(F.xxhash64("canon"), F.lit(n_blocks)).alias("block")).agg(F.bit_or(_bits(F.col("canon"))).alias("bits"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages` (page_id, url); `listed` has blocked addresses in `url`."""
    host, path, query = parts(F.col("url"))
    listed = listed.select(host.alias("h"), path.alias("p"), query.alias("q")).where("h <> ''").select(canonical(F.col("h"), F.col("p"), F.col("q")).alias("canon")).distinct()
    listed = stage(listed, "listed-urls")
    n, n_bytes = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("canon") + 16), F.lit(0))).first()
    n_blocks = max(1, -(-n // KEYS_PER_BLOCK))
    words = bloom(listed, n_blocks)
    words = F.broadcast(words) if n_blocks <= BROADCAST_BLOCKS else words
    listed = listed.select(F.col("canon").alias("listed"))
    listed = F.broadcast(listed) if n_bytes <= BROADCAST_BYTES else listed

    judged = with_parts(pages).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    # Rows that a rule decides or that have no address ask for a block or address of their own that isn't there, so that they meet in no task.
    asks = F.col("fit").isNull() & F.col("canon").isNotNull()
    nowhere = F.xxhash64("page_id", "host", "path").bitwiseOR(F.lit(-(2**63)))
    tested = judged.withColumn("at", F.when(asks, F.pmod(F.xxhash64("canon"), F.lit(n_blocks))).otherwise(nowhere)).join(words, F.col("at") == F.col("block"), "left")
    maybe = F.col("bits").bitwiseAND(_bits(F.col("canon"))) == _bits(F.col("canon"))
    probe = F.when(F.coalesce(maybe, F.lit(False)), F.col("canon")).otherwise(F.concat(F.lit("://"), nowhere.cast("string")))
    exact = tested.withColumn("probe", probe).join(listed, F.col("probe") == F.col("listed"), "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("listed").isNotNull(), "block").otherwise("allow"))
    return exact.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
