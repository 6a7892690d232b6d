"""URL rules by a sort-merge range join (DataFrame functions only).

A rule (host, path) fits its host, all subdomains, and every path that starts with its
own. Host labels are reversed and joined, `com?example?www`, and the path follows after a
slash, so that a rule is a prefix of the keys it fits and therefore an interval in their
sorted order; neither sign can stand in a host. A url has one key for each suffix of its
host, up to the labels of the rule that has most.

Rules and keys are sorted together. At any place the active rules form a stack: the
rule that started last, and below it the rules that enclose it, since prefixes either
nest or are disjoint. A rule carries its enclosing rules along, so that the stack at a
url is found from the rule that started last, by popping what does not enclose the url.

The order is cut into ranges; each range starts with the last rule of those before it.
Equal keys are told apart by page, so one url or host may hold any share of the rows.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from procwatch.session import materialize

ALLOW, BLOCK = "allow", "block"
_PART_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def range_key(labels: Column, path: Column) -> Column:
    """Key of reversed host labels and a path; a rule's key is a prefix of the keys it fits."""
    return F.concat(F.array_join(labels, "?"), F.lit("/"), path)


def url_keys(host: Column, path: Column, most: int) -> Column:
    """The keys of the host's suffixes of up to `most` labels. An empty host has one key."""
    labels = _labels(host)
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))),
                       lambda n: range_key(F.slice(labels, 1, n), path))


def keyed_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with key, text and the stack they stand on.

    A rule with a null part is no rule. Of rules with equal host and path, `block` counts.
    The enclosing rules of a rule are those whose key is one of its key's prefixes; they
    have the same host suffix, so only prefixes that end in the path count.
    """
    valid = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    lowered = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    one = (valid.groupBy(lowered.alias("host"), "path")
           .agg(F.max("verdict").alias("verdict"))  # 'block' after 'allow'
           .select(range_key(_labels(F.col("host")), F.col("path")).alias("key"),
                   F.concat("host", "path").alias("rule"), "verdict"))
    starts = F.length(F.substring_index("key", "/", 1)) + 1
    prefixes = one.select(
        F.col("key").alias("full"),
        F.explode(F.sequence(starts, F.length("key"))).alias("n")).select(
        "full", F.substring(F.col("full"), F.lit(1), F.col("n")).alias("key"))
    stacks = (prefixes.join(one, "key")
              .groupBy("full").agg(F.sort_array(F.collect_list(F.struct(
                  F.length("key").alias("n"), "key", "rule", "verdict"))).alias("stack")))
    return stacks.select(F.col("full").alias("key"), "stack")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id",
          default: str = ALLOW) -> DataFrame:
    """Rows of `pages` as (page_id, host, path, rule, verdict): the longest rule decides.

    A null url, or one without `://`, has empty host and path, so no rule with a host fits
    it. Without a fitting rule `rule` is null and the verdict is `default`. Repeated rows and
    null ids are judged row by row. An empty table of pages gives no rows; without rules all
    verdicts are the default. Other columns, whatever their names, are not read.
    """
    urls = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"),
                        path_of(F.col(url)).alias("path"))
    most = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1
    keys = (urls.withColumn("row", F.monotonically_increasing_id())
            .withColumn("key", F.explode(url_keys(F.col("host"), F.col("path"), most))))
    starts = keyed_rules(rules).select("key", "stack", F.lit(0).alias("kind"))
    both = starts.unionByName(keys.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    # written once, as the place of a row depends on the layout of the tasks
    ordered = materialize(
        both.repartitionByRange("key", "kind", "page_id", "row")
        .sortWithinPartitions("key", "kind", "page_id", "row")
        .withColumn("at", F.monotonically_increasing_id()), "url-order")
    placed = ordered.withColumn("part", F.shiftright("at", _PART_BITS))
    lasts = placed.where("kind = 0").groupBy("part").agg(F.max_by("stack", "at").alias("last"))
    parts = placed.select("part").distinct().join(lasts, "part", "left")
    carried = parts.select("part", F.last("last", ignorenulls=True).over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # `carried` has one row per range, so its size is bounded by the number of ranges
    swept = (placed.withColumn("seen", F.last("stack", ignorenulls=True).over(sweep))
             .where("kind = 1").join(F.broadcast(carried), "part"))
    active = F.filter(F.coalesce("seen", "carried"), lambda rule: F.col("key").startswith(rule["key"]))
    top = F.try_element_at(active, F.lit(-1))
    best = F.max(F.struct(F.length(top["rule"]).alias("n"), top["rule"].alias("rule"),
                          top["verdict"].alias("verdict")))
    return (swept.groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
            .select("page_id", "host", "path", "best.rule",
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
