"""Operator 6: URL filters by a trie over reversed host labels and path segments.

A rule is (verdict, host, path): it fits its host and every subdomain when the URL's path starts with the
rule's path. The longest rule wins: more host labels first, then the longer path; of two equal rules the
first one given, or of a table of rules, which has no order, the verdict that comes first in the alphabet. The trie is broadcast while the rules stay below
``MAX_BROADCAST`` bytes; beyond, the host suffixes of the distinct URLs (a few each) are joined with the rule table instead, with the
same results; a suffix that many URLs share, like ``com``, is dealt over ``SALTS`` keys, to each of which its rules go.

Defined results: a null url, or one without ``://``, has an empty host and an empty path and fits no rule; urls of any length are judged
whole; repeated rows are judged each; an empty table gives an empty result, and no rules give every url the default; other
columns pass through, except that columns named like an output column are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Bytes of all rules up to which the trie is broadcast.
MAX_BROADCAST = 16 << 20
#: Keys over which each suffix is dealt beyond that.
SALTS = 16
Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first ``://`` up to / ? # or the end, A-Z in lower case; path: then up to ? or #."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [k for k in (rest.find(c) for c in "?#") if k >= 0]
    rest = rest[: min(ends)] if ends else rest
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


class Trie:
    """Nodes are dicts; ``None`` leads from a host node to its path tree; rules end inside or at a segment."""

    def __init__(self, rules: list[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {"next": {}, "ends": {}})
            *whole, last = path.split("/")
            for segment in whole:
                node = node["next"].setdefault(segment, {"next": {}, "ends": {}})
            node["ends"].setdefault(last, (verdict, host + path))
            node["sizes"] = sorted({*node.get("sizes", ()), len(last)}, reverse=True)

    @staticmethod
    def _longest(node: dict | None, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if node is None:
                break
            for size in node.get("sizes", ()):  # the segment's beginnings, longest first, looked up
                if size <= len(segment) and (found := node["ends"].get(segment[:size])):
                    best = found
                    break
            node = node["next"].get(segment)
        return best

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest fitting rule."""
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            if (node := node.get(label)) is None:
                break
            best = self._longest(node.get(None), segments) or best
        return best


def _native_parts(url) -> tuple:
    rest = F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow", keep: list[str] | None = None, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """pages with host, path, rule and verdict; rules: tuples, or a table (verdict, host, path)."""
    spark = pages.sparkSession
    new = ["host", "path", "rule", "verdict"]
    keep = shared.without(pages.columns if keep is None else keep, new)
    if isinstance(rules, DataFrame):
        table = rules.select("verdict", "host", "path")
        size = table.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0))).first()[0]
        if size > max_broadcast:
            return _joined(pages, table.withColumn("nth", F.lit(0)), url, default, keep)
        rules = sorted(tuple(r) for r in table.collect())
    if sum(len(h.encode()) + len(p.encode()) + 64 for _, h, p in rules) > max_broadcast:
        return _joined(pages, spark.createDataFrame([(*r, k) for k, r in enumerate(rules)], "verdict string, host string, path string, nth int"), url, default, keep)
    trie = spark.sparkContext.broadcast(Trie(rules))
    (at,) = shared.free([*keep, *new], "url_to_judge")
    source = pages.select(*[pages[c] for c in keep], pages[url].alias(at))

    def run(batches):
        t = trie.value
        for b in batches:
            parts = [host_and_path(u) for u in b.column(at).to_pylist()]
            found = [t.judge(h, p) or (default, None) for h, p in parts]
            cols = [[h for h, _ in parts], [p for _, p in parts], [r for _, r in found], [v for v, _ in found]]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [pa.array(c, pa.string()) for c in cols], names=keep + new)

    return source.mapInArrow(run, T.StructType([source.schema[c] for c in keep] + [T.StructField(n, T.StringType()) for n in new]))


def _joined(pages: DataFrame, rules: DataFrame, url: str, default: str, keep: list[str]) -> DataFrame:
    """The same through an equi-join on host suffixes of the distinct hosts and paths."""
    host, path = _native_parts(pages[url])
    rows = pages.select(*[pages[c] for c in keep], host.alias("host"), path.alias("path"))
    h, p, best = shared.free([*keep, "host", "path", "rule", "verdict"], "h", "p", "best")
    u = rows.where("host <> ''").select(F.col("host").alias(h), F.col("path").alias(p)).distinct()
    labels = F.split(F.col(h), r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("suffix")
    suffixes = u.select(h, p, suffix, F.pmod(F.xxhash64(h, p), F.lit(SALTS)).cast("int").alias("salt"))
    r = rules.groupBy(F.col("host").alias("suffix"), F.col("path").alias("begin")).agg(F.min(F.struct("nth", "verdict"))["verdict"].alias("v"))
    r = r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    order = F.struct(F.size(F.split("suffix", r"\.")).alias("a"), F.length("begin").alias("b"))
    found = suffixes.join(r, ["suffix", "salt"]).where(F.startswith(p, "begin")).groupBy(h, p).agg(F.max_by(F.struct(F.concat("suffix", "begin").alias("rule"), F.col("v").alias("verdict")), order).alias(best))
    judged = rows.join(found, (rows["host"] == found[h]) & (rows["path"] == found[p]), "left")
    return judged.select(*keep, "host", "path", F.col(f"{best}.rule").alias("rule"), F.coalesce(f"{best}.verdict", F.lit(default)).alias("verdict"))


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")
