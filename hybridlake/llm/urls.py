"""URL filter: allow and block rules in a trie over reversed host labels, then path segments; the longest match wins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hybridlake.llm.texts import fresh

#: Rules of one trie; a longer list is matched trie by trie, each broadcast, and the longest match of all is kept.
RULES_PER_TRIE = 200_000
DEFAULT_VERDICT = "allow"

Rule = tuple[str, str, str]  # verdict, host, path

# The rules of the registered query.
PAGE_RULES: list[Rule] = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
]


class HostNode:
    """Labels read so far, from the last to the first; ``paths`` roots the paths of the rules of this host."""

    __slots__ = ("labels", "paths")

    def __init__(self) -> None:
        self.labels: dict[str, HostNode] = {}
        self.paths: PathNode | None = None


class PathNode:
    """Whole segments read so far; ``tails`` holds the rules whose last segment may be cut short, longest first."""

    __slots__ = ("segments", "tails")

    def __init__(self) -> None:
        self.segments: dict[str, PathNode] = {}
        self.tails: list[tuple[str, str, str]] = []


def rule_trie(rules: Sequence[Rule]) -> HostNode:
    root = HostNode()
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"a rule is allow or block, with a host: {(verdict, host, path)}")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.labels.setdefault(label, HostNode())
        node.paths = node.paths or PathNode()
        at = node.paths
        *whole, tail = path.split("/")
        for segment in whole:
            at = at.segments.setdefault(segment, PathNode())
        at.tails.append((tail, f"{host}{path}", verdict))
        # The longest tail first; of two equal rules, the one that blocks.
        at.tails.sort(key=lambda t: (-len(t[0]), t[2] != "block"))
    return root


def match(root: HostNode, host: str, path: str) -> tuple[str, str] | None:
    """Rule and verdict of the longest fit: most host labels first, then the longest path."""
    hosts, node = [], root
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        if node.paths is not None:
            hosts.append(node.paths)
    segments = path.split("/")
    for at in reversed(hosts):
        best = None
        for segment in segments:
            best = next((t for t in at.tails if segment.startswith(t[0])), best)
            at = at.segments.get(segment)
            if at is None:
                break
        if best:
            return best[1], best[2]
    return None


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased; '' without ``://``."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; '' without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def matched(spark, host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, NULL where none does."""
    found = [_look_up(spark, rules[i:i + RULES_PER_TRIE])(host, path) for i in range(0, len(rules), RULES_PER_TRIE)]
    return reduce(_longer, found)


def _look_up(spark, rules: Sequence[Rule]):
    trie = spark.sparkContext.broadcast(list(rules))  # RULES_PER_TRIE at most

    @F.pandas_udf("rule string, verdict string, labels int")
    def look_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        root = rule_trie(trie.value)
        for hosts, paths in batches:
            found = [match(root, h, p) or (None, None) for h, p in zip(hosts, paths)]
            yield pd.DataFrame({
                "rule": [f[0] for f in found], "verdict": [f[1] for f in found],
                "labels": [f[0].split("/", 1)[0].count(".") + 1 if f[0] else 0 for f in found],
            })

    return look_up


def _longer(a: Column, b: Column) -> Column:
    """The struct with more labels, then the longer rule; blocking wins between equals."""
    rank = lambda s: F.struct(
        F.coalesce(s["labels"], F.lit(0)).alias("labels"), F.coalesce(F.length(s["rule"]), F.lit(0)).alias("size"),
        (s["verdict"] == "block").alias("blocks"))
    return F.when(rank(a) >= rank(b), a).otherwise(b)


def judged(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` in place of columns of those names.

    A rule fits its host and every subdomain of it, if the url's path starts with the rule's path. A url without
    ``://`` and a NULL one have an empty host and path; what no rule fits gets ``default`` and a NULL rule. With no
    rules at all, every url gets the default. Rows are judged one by one, so repeated rows agree.
    """
    kept = [F.col(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    source = F.coalesce(F.col(url), F.lit(""))
    cut = pages.select(*kept, host_of(source).alias("host"), path_of(source).alias("path"))
    names = [c for c in cut.columns if c not in ("host", "path")]
    if not rules:
        return cut.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    best = fresh(cut, "found_rule")
    found = cut.withColumn(best, matched(pages.sparkSession, F.col("host"), F.col("path"), rules))
    return found.select(
        *names, "host", "path", F.col(best)["rule"].alias("rule"),
        F.coalesce(F.col(best)["verdict"], F.lit(default)).alias("verdict"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url judged by the fixed rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, PAGE_RULES).drop("url").select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
"""
