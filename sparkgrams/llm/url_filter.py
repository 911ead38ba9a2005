"""URL filters: a sort-merge range join of urls with host/path rules.

A rule ``(host, path, verdict)`` covers its host, all subdomains and every path
that starts with its own. Writing the host's labels in reverse order turns a
rule of ``d`` labels into the interval of all keys that start with
``label1/../labeld/path``; a url has one key for each depth ``d`` that occurs
among the rules. Urls and rules are sorted together once for each depth, and
the sweep over the sorted keys carries the stack of rules that are open there:
the nearest rule at or before a key has, with the rules nested around it, every
interval that can hold the key.

The whole path is DataFrame functions. Urls are dealt by a hash of the row, not
by host, so that a hot host spreads over all partitions; rules are copied to
each of those groups, block by block, so their copies stay bounded whatever the
number of rules.

Defined results: a null url, or one without ``://``, has an empty host and path
and gets the default verdict; equal keys of several rows are all kept; of rules
with equal host and path the first one listed counts; an empty table gives an
empty result; columns of the input other than the two named are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import pick

#: Rules copied to each group of urls in one sweep.
RULE_BLOCK = 10_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) text between the first ``://`` and ``/``, ``?``, ``#``
    or the end; empty for null or a url without ``://``."""
    return F.translate(_part(url, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Text from the host's end up to ``?``, ``#`` or the end."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*+://([^/?#]*+)([^?#]*+)", group), F.lit(""))


def _stacks(keys: list[str]) -> list[list[int]]:
    """For each of the sorted keys the positions of the keys that are a prefix
    of it, itself included: a sweep that keeps a stack of open intervals."""
    stack: list[int] = []
    out = []
    for position, key in enumerate(keys):
        while stack and not key.startswith(keys[stack[-1]]):
            stack.pop()
        stack.append(position)
        out.append(list(stack))
    return out


STACK = "array<struct<key:string,rule:string,verdict:string,n:int,h:int>>"


def _literal_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The rules of one block as a table that needs no Python to read."""
    schema = f"array<struct<key:string,chain:{STACK}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def _entry(key: str, host: str, path: str, verdict: str) -> dict:
    return {"key": key, "rule": host + path, "verdict": verdict, "n": len(host + path), "h": len(host)}


def _covers(key: Column):
    return lambda rule: F.startswith(key, rule["key"])


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    groups: int | None = None,
    rule_block: int = RULE_BLOCK,
) -> DataFrame:
    """Judge every url by the longest rule that covers it.

    Returns ``id_col, host, path, rule, verdict``; ``rule`` is host and path of
    the deciding rule or null, ``verdict`` the rule's or ``default``. Longest
    means most characters in host and path together, then in the host.
    """
    spark = pages.sparkSession
    urls = pick(pages, id_col, url_col).select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    known: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        known.setdefault((host.lower(), path), verdict)
    by_depth: dict[int, list[tuple[str, str, str, str]]] = {}
    for (host, path), verdict in known.items():
        labels = host.split(".")[::-1]
        by_depth.setdefault(len(labels), []).append(("/".join(labels) + "/" + path, host, path, verdict))
    sweeps: list[tuple[int, list[tuple[str, str, str, str]]]] = []
    for depth, listed in sorted(by_depth.items()):
        listed.sort(key=lambda r: r[0].encode())
        # a block starts with what is open there, so that each block is swept alone
        stacks = _stacks([r[0] for r in listed])
        for at in range(0, len(listed), rule_block):
            opened = [listed[i] for i in stacks[at][:-1]]
            sweeps.append((depth, opened + listed[at : at + rule_block]))
    if not sweeps:
        return urls.select(
            F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )

    groups = groups or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = F.reverse(F.split("host", r"\.", -1))
    swept = urls.withColumn("g", F.pmod(F.xxhash64("id", "host", "path"), F.lit(groups)).cast("int")).withColumn("labels", labels)
    for n, (depth, _) in enumerate(sweeps):
        # both is null for rows of the other kind: those sort first and change nothing
        key = F.when(F.size("labels") >= depth, F.concat(F.array_join(F.slice("labels", 1, depth), "/"), F.lit("/"), F.col("path")))
        swept = swept.withColumn(f"k{n}", key).withColumn(f"s{n}", F.lit(None).cast(STACK))
    swept = swept.drop("labels").withColumn("is_url", F.lit(1))

    for n, (_, block) in enumerate(sweeps):
        rows = []
        for (key, *_), stack in zip(block, _stacks([r[0] for r in block]), strict=True):
            chain = [_entry(*block[i]) for i in reversed(stack)]
            rows.append({"key": key, "chain": chain})
        copies = _literal_table(spark, rows).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
            "g", F.lit(0).alias("is_url"), F.col("key").alias(f"k{n}"), F.col("chain").alias(f"s{n}")
        )
        swept = swept.unionByName(copies, allowMissingColumns=True)

    for n in range(len(sweeps)):
        window = Window.partitionBy("g").orderBy(F.col(f"k{n}").asc_nulls_first(), "is_url").rowsBetween(Window.unboundedPreceding, 0)
        stack = F.last(f"s{n}", ignorenulls=True).over(window)
        swept = swept.withColumn(f"o{n}", F.when(F.col(f"k{n}").isNotNull(), stack))
    for n in range(len(sweeps)):
        fits = F.filter(f"o{n}", _covers(F.col(f"k{n}")))
        swept = swept.withColumn(f"w{n}", F.try_element_at(fits, F.lit(1)))

    found = [F.when(F.col(f"w{n}").isNotNull(), F.struct(f"w{n}.n", f"w{n}.h", f"w{n}.rule", f"w{n}.verdict")) for n in range(len(sweeps))]
    best = F.greatest(*found) if len(found) > 1 else found[0]
    return (
        swept.filter("is_url = 1")
        .withColumn("best", best)
        .select(
            F.col("id").alias(id_col),
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        )
    )
