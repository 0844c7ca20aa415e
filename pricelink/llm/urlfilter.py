"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join of the possible hits.

A list entry is a host and a path with a verdict; it fits its host and all subdomains of it, if the URL's path
starts with the entry's. Of the entries of a class that fit, the longest (host, then path) decides.

Entries of class 0 are rules and are held against the host as it is written; those of other classes are listed hosts in
canonical form (lower case, without user, port and trailing dots), and are held against the URL's canonical host.

The candidates of a URL are its host and parent domains that are no longer than the longest listed host, each with its
path cut to every length that occurs in the list (and ends within the path). The Bloom filter holds the list's keys:
each key sets BLOOM_BITS bits within one block of 64. It has a bounded number of blocks (a documented parameter,
MAX_BLOCKS), reaches the tasks as one array, and drops most candidates before anything is shuffled; the join that
follows compares the keys themselves, so false positives cost time, never results. Rows without any possible hit are
never shuffled. A long URL takes time by its length: only the end of its host is cut into domains.

Null and unparsable URLs have empty host and path and fit no entry. Equal rows are counted together and given back
one by one. An empty table or list gives an empty result or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BLOCKS, bloom_filter, lower_ascii, may_hold


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column) -> Column:
    """A host without user, port and trailing dots."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", ""), F.lit("."))


def key(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def candidates(host: Column, path: Column, lengths: Column, longest: Column, rules: Column) -> Column:
    """(host suffix, path prefix, rules) for the host and all parent domains of at most `longest` characters, and all
    listed path lengths."""
    tail = F.right(host, longest + 1)
    labels = F.split(tail, r"\.")
    whole = F.length(host) <= longest
    starts = F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: (i > 1) | whole)
    suffixes = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(lengths, lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda n: F.struct(s.alias("host"), F.substring(path, F.lit(1), n).alias("path"), rules.alias("rules")))))
    return F.when(host == "", F.array().cast(pairs_type)).otherwise(pairs)


pairs_type = "array<struct<host:string,path:string,rules:boolean>>"


def matches(urls: DataFrame, entries: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """`keep` columns, host, path, and `hits`: for each class of the list, from 0, the longest entry that fits as
    (class, size, entry, verdict). `entries`: host, path, verdict, class; the list may be of any size."""
    entries = entries.select("host", "path", "verdict", "class").distinct()
    n = entries.count()
    lengths = F.sort_array(F.coalesce(entries.agg(F.collect_set(F.length("path"))).scalar(), F.array().cast("array<int>")))
    longest = F.coalesce(entries.agg(F.max(F.length("host"))).scalar(), F.lit(0))
    filter_bits, n_blocks = bloom_filter(entries.select(F.xxhash64(key(F.col("host"), F.col("path"))).alias("h")), n, max_blocks)
    possible = lambda x: may_hold(F.col("_bloom"), n_blocks, F.xxhash64(key(x["host"], x["path"])))
    parts = urls.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    probed = parts.withColumn("_lengths", lengths).withColumn("_longest", longest).withColumn("_bloom", filter_bits)
    written_as, plain = (candidates(h, F.col("path"), F.col("_lengths"), F.col("_longest"), F.lit(r)) for h, r in ((F.col("host"), True), (canonical(F.col("host")), False)))
    probed = probed.withColumn("_maybe", F.filter(F.concat(written_as, plain), possible)).drop("_bloom", "_lengths", "_longest")
    none = probed.where(F.size("_maybe") == 0).select(*keep, "host", "path", F.array().cast(hits_type).alias("hits"))
    counted = probed.where(F.size("_maybe") > 0).groupBy(*keep, "host", "path", "_maybe").agg(F.count(F.lit(1)).alias("_copies"))
    each = counted.withColumn("_x", F.explode("_maybe")).withColumn("_key", key(F.col("_x.host"), F.col("_x.path")))
    listed = entries.select(key(F.col("host"), F.col("path")).alias("_lkey"), F.col("host").alias("_lhost"), F.col("path").alias("_lpath"), F.col("verdict").alias("_verdict"), F.col("class").alias("_class"))
    joined = each.join(listed, (F.col("_key") == F.col("_lkey")) & (F.col("_x.host") == F.col("_lhost")) & (F.col("_x.rules") == (F.col("_class") == 0)), "left")
    hit = F.struct(F.col("_class").alias("class"), F.length("_lhost").alias("host_size"), F.length("_lpath").alias("path_size"), F.col("_lkey").alias("entry"), F.col("_verdict").alias("verdict"))
    best = joined.groupBy(*keep, "host", "path", "_copies").agg(F.sort_array(F.collect_list(F.when(F.col("_lkey").isNotNull(), hit)), asc=False).alias("hits"))
    again = best.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*keep, "host", "path", F.col("hits").cast(hits_type))
    return none.union(again)


hits_type = "array<struct<class:int,host_size:int,path_size:int,entry:string,verdict:string>>"


def longest(hits: Column, cls: int) -> Column:
    """The longest entry of a class: host and path together, the verdict `block` first on a tie."""
    mine = F.filter(hits, lambda h: h["class"] == cls)
    ranked = F.array_sort(F.transform(mine, lambda h: F.struct((-(h["host_size"] + h["path_size"])).alias("minus"), (h["verdict"] != "block").alias("mild"), h["entry"].alias("entry"), h["verdict"].alias("verdict"))))
    return F.get(ranked, F.lit(0))


#: The rules of the URL policy (class 0), and listed hosts of advertising and spam (class 1).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LISTED = ["cheap-pills", "free-bets", "spam-farm", "adult-x", "casino-win", "ads-track"]
LISTED_UNDER = ["example.com", "example.net", "example.org"]


def policy(spark) -> DataFrame:
    listed = [(f"{name}.{top}", "", "block", 1) for name in LISTED for top in LISTED_UNDER]
    rows = [F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict", "class"), r)]) for r in [(*r, 0) for r in RULES] + listed]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judged(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, path, the rule of class 0 that decides (or null), and the verdict: the rule's, else that of the
    list of class 1, else allow."""
    found = matches(pages, entries).withColumn("_rule", longest(F.col("hits"), 0)).withColumn("_listed", longest(F.col("hits"), 1))
    return found.select("page_id", "host", "path", F.col("_rule.entry").alias("rule"), F.coalesce("_rule.verdict", "_listed.verdict", F.lit("allow")).alias("verdict"), F.col("_listed.entry").alias("listed"))
