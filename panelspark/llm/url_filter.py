"""URL verdicts: host and path rules, then a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.common import Stored

# Query parameters that do not change a page; fixed values.
TRACKING = r"^(utm_[^=]*|fbclid|gclid|ref)(=|\z)"
_BITS_PER_KEY = 16
_WORDS = 4  # of 64 bits: a block of 256 bits, a bit of each word per key
MAX_BLOCKS = 1 << 18


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to
    ``?``, ``#`` or the end. Both empty without ``://``."""
    pattern = r"(?s)^(?:(?!://).)*://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(url, pattern, 1), letters, letters.lower()), F.regexp_extract(url, pattern, 2)


def canonical(url: Column, host: Column, path: Column) -> Column:
    """Host without www. or m., path without closing slashes, parameters in order save tracking ones."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"/+\z", ""),
                    F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest (host, path, verdict) rule that fits, as text, and its verdict; nulls if none fits."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, says).otherwise(verdict)
    return name, verdict


def _block(n_blocks: int) -> Column:
    return F.pmod(F.xxhash64("canonical"), F.lit(n_blocks))


def _masks() -> list[Column]:
    """A bit for each word, from six bits each of a second hash."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(canonical, 'bits'), {6 * i}) & 63 as int))") for i in range(_WORDS)]


def bloom_filter(listed: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """Blocks of the filter as rows (block, w0..w3), and their number, which grows with the list."""
    n_blocks = 64
    while n_blocks * 64 * _WORDS < n_keys * _BITS_PER_KEY:
        n_blocks *= 2
    words = [F.bit_or(m).alias(f"w{i}") for i, m in enumerate(_masks())]
    return listed.groupBy(_block(n_blocks).alias("block")).agg(*words), n_blocks


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and listed of every row.

    ``listed`` has one column of URLs to block, in any form. A URL is listed if the canonical forms are equal. The
    filter has 16 bits for each listed URL, so it lets through all listed URLs and few others; only these are
    shuffled to the exact join, where one much repeated URL is split by adaptive execution. Up to MAX_BLOCKS rows, some four million
    URLs, the filter goes to every executor; a larger one is a table that pages meet by block. A null URL or one
    without ``://`` has an empty host and path, is never listed, and is allowed. Repeated rows and null ids
    stay; an empty table gives no rows, an empty list blocks nothing. Other columns are not read.
    """
    def parsed(rows: DataFrame, col: str, *more: Column) -> DataFrame:
        rows = rows.select(*more, F.col(col).alias("url"))
        host, path = host_and_path(F.col("url"))
        rows = rows.withColumns({"host": host, "path": path})
        return rows.withColumn("canonical", F.when(F.col("host") == "", "").otherwise(
            canonical(F.col("url"), F.col("host"), F.col("path"))))

    keys = parsed(listed, listed.columns[0]).where(F.col("canonical") != "").select("canonical").distinct()
    keys = Stored(keys, "listed").df
    blocks, n_blocks = bloom_filter(keys, keys.count())
    blocks = Stored(blocks, "bloom").df
    rows = parsed(pages, url_col, F.col(id_col).alias("page_id")).withColumn("block", _block(n_blocks))
    probed = rows.drop("url").join(F.broadcast(blocks) if n_blocks <= MAX_BLOCKS else blocks, "block", "left")
    passes = F.lit(True)
    for i, m in enumerate(_masks()):
        passes &= F.coalesce(F.col(f"w{i}").bitwiseAND(m), F.lit(0)) != 0
    probed = probed.withColumn("possible", passes).select("page_id", "host", "path", "canonical", "possible")
    hits = probed.where("possible").join(keys.withColumn("listed", F.lit(True)), "canonical", "left")
    both = hits.unionByName(probed.where(~F.col("possible")).withColumn("listed", F.lit(False)))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    is_listed = F.coalesce("listed", F.lit(False))
    return both.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(
        says, F.when(is_listed, "block").otherwise("allow")).alias("verdict"), is_listed.alias("listed"))
