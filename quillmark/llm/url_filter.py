"""URL rules in a trie over reversed host labels, then path segments; the longest wins.

A rule is (action, host, path). It fits its host and every subdomain of it, for urls whose
path begins with the rule's. Among fitting rules the one with more host labels wins, then
the one with the longer path, then ``block``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written


class Rule(NamedTuple):
    action: str
    host: str
    path: str


#: A trie is broadcast to every executor and holds so many bytes of rules at most; more rules
#: are tries of their own, one pass after the other.
MAX_RULE_BYTES = 64 << 20


def rule_bytes(rule: Rule) -> int:
    return len(rule.host) + len(rule.path) + 64

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null or without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    m = _HOST_END.search(rest)
    if not m:
        return rest.translate(_LOWER), ""
    path = rest[m.start() :]
    end = _PATH_END.search(path)
    return rest[: m.start()].translate(_LOWER), path[: end.start()] if end else path


class _Beginnings:
    """Rules by the text that a segment must begin with; they are looked up by the few lengths
    that there are, so many rules beside one another cost no more than one."""

    def __init__(self):
        self._rules: dict[str, Rule] = {}
        self._lengths: list[int] = []

    def add(self, text: str, rule: Rule) -> None:
        if text not in self._rules or rule.action == "block":
            self._rules[text] = rule
        if len(text) not in self._lengths:
            self._lengths = sorted([*self._lengths, len(text)], reverse=True)

    def longest(self, segment: str) -> Rule | None:
        for n in self._lengths:
            if n <= len(segment) and (rule := self._rules.get(segment[:n])):
                return rule
        return None


class Trie:
    """Nodes are dicts from a label or segment to a node. A host ends where its node has an
    entry of paths: a tree over whole segments whose nodes keep, for the rules that end
    there, the beginnings that the next segment must have."""

    def __init__(self, rules: Iterable[Rule]):
        self._hosts: dict = {}
        size = 0
        for rule in rules:
            size += rule_bytes(rule)
            if size > MAX_RULE_BYTES:
                raise ValueError("too many rules to broadcast")
            node = self._hosts
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            if None not in node:
                node[None] = _Beginnings()
            node[None].add(last, rule)

    def find(self, host: str, path: str) -> Rule | None:
        node, trees = self._hosts, []
        if None in node:
            trees.append(node[None])
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                trees.append(node[None])
        for tree in reversed(trees):  # more labels first
            if rule := self._path(tree, path.split("/")):
                return rule
        return None

    @staticmethod
    def _path(node: dict, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            if None in node and (rule := node[None].longest(segment)):
                best = rule  # deeper nodes come later and are longer
            node = node.get(segment)
            if node is None:
                break
        return best


def _bounded(rules: Iterable[Rule]) -> Iterator[list[Rule]]:
    """The rules in lists that a trie may hold."""
    held, size = [], 0
    for rule in rules:
        if held and size + rule_bytes(rule) > MAX_RULE_BYTES:
            yield held
            held, size = [], 0
        held.append(rule)
        size += rule_bytes(rule)
    yield held


_FOUND = "host string, path string, rule string, verdict string, labels int, length int"


def judge_urls(urls: DataFrame, column: str, rules: list[Rule], otherwise: str = "allow") -> DataFrame:
    """Add host, path, rule (host and path of the winning one, else null) and verdict.

    A null url has empty host and path, which only a rule without either fits. One pass,
    no shuffle; the trie is broadcast and its size checked. Rules of more than one trie take
    a pass each, over a table written in between, and the same precedence among their
    winners. Repeated rows are judged each for itself, an empty table gives no rows, a url is
    read whole whatever its length, and columns of the added names give way.
    """
    spark = urls.sparkSession

    def judged(own: list[Rule]):
        trie = spark.sparkContext.broadcast(Trie(own))

        @F.pandas_udf(_FOUND)
        def found(column: pd.Series) -> pd.DataFrame:
            find, out = trie.value.find, []
            for url in column:
                host, path = split_url(url)
                if rule := find(host, path):
                    labels = rule.host.count(".") + 1 if rule.host else 0
                    out.append((host, path, rule.host + rule.path, rule.action, labels, len(rule.path)))
                else:
                    out.append((host, path, None, otherwise, -1, -1))
            return pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "labels", "length"])

        return found(F.col(f"`{column}`"))

    place = "_judged"
    while place in urls.columns:
        place += "_"
    first, *more = _bounded(rules)
    out = urls.withColumn(place, judged(first))
    for own in more:
        out = written(out, "judged-urls").withColumn(f"{place}2", judged(own))
        old, new = (lambda x: F.col(f"{place}.{x}")), (lambda x: F.col(f"{place}2.{x}"))
        rank = lambda x: F.struct(x("labels"), x("length"), x("verdict") == "block")
        better = (new("labels") >= 0) & (rank(new) > rank(old))
        out = out.withColumn(place, F.when(better, F.col(f"{place}2")).otherwise(F.col(place))).drop(f"{place}2")
    added = ("host", "path", "rule", "verdict")
    kept = [c for c in urls.columns if c not in added]
    return out.select(*[F.col(f"`{c}`") for c in kept], *(F.col(f"{place}.{c}") for c in added))


RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


def op8_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, "url", RULES).select("page_id", "host", "path", "rule", "verdict")


_SPLIT = r"""
cut AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut)
"""
OP8_SQL = f"""
WITH {_SPLIT.strip()},
rules(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (SELECT page_id, action, h || p AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(h) - length(replace(h, '.', '')) DESC, length(p) DESC, action DESC) AS rn
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND rn = 1
"""
