"""Operator 9: URL rules as a bit-parallel wildcard automaton.

Each rule is a glob over the canonical URL ``.host<FF>path`` (byte FF occurs in no UTF-8
text, so it separates host and path without doubt). In a glob, ``*`` stands for any run of bytes
before the separator, ``**`` for any run, ``?`` for one byte. ``GlobAutomaton`` packs the
states of all globs into one bit vector of several 64-bit words and moves them together, one
byte at a time, over a whole batch of URLs (Shift-And with self loops for the wildcards).

Defined cases: a null URL, or one without ``://``, has empty host and path and meets no
rule; repeated rows are judged each; an empty table gives an empty result; other columns of
the input are ignored unless asked for. A URL that no rule fits gets ``default``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm.common import ascii_lower, ship, table

ship(__name__)

SEPARATOR = b"\xff"


@dataclass(frozen=True)
class UrlRule:
    """``host`` and its subdomains, paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> list:
        return ["*", *f".{self.host}".encode(), SEPARATOR[0], *self.path.encode(), "**"]


class GlobAutomaton:
    """``globs``: lists of byte values and the wildcards ``"?"``, ``"*"``, ``"**"``."""

    def __init__(self, globs: Sequence[Sequence]):
        states = sum(1 + sum(x not in ("*", "**") for x in g) for g in globs)
        self.words = max(1, -(-states // 64))
        self.step = np.zeros((256, self.words), np.uint64)  # states that a byte lets be entered
        self.stay = np.zeros((256, self.words), np.uint64)  # states that a byte leaves as they are
        self.first = np.zeros(self.words, np.uint64)
        self.last: list[tuple[int, np.uint64]] = []
        at = 0
        for g in globs:
            self._set(self.first, at)
            for x in g:
                if x == "**":
                    self._set(self.stay, at)
                elif x == "*":
                    self._set(self.stay[: SEPARATOR[0]], at)
                else:
                    at += 1
                    self._set(self.step if x == "?" else self.step[x : x + 1], at)
            self.last.append((at // 64, np.uint64(1 << at % 64)))
            at += 1

    @staticmethod
    def _set(masks: np.ndarray, state: int) -> None:
        masks[..., state // 64] |= np.uint64(1 << state % 64)

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """End states (n, words) of the byte strings data[start : start + length]."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        s = np.repeat(self.first[None, :], len(starts), axis=0)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # strings that are longer than t
            c = data[starts[:n] + t]
            moved = s[:n] << np.uint64(1)
            moved[:, 1:] |= s[:n, :-1] >> np.uint64(63)
            s[:n] = (moved & self.step[c]) | (s[:n] & self.stay[c])
        out = np.empty_like(s)
        out[order] = s
        return out

    def first_match(self, strings: Sequence[bytes]) -> np.ndarray:
        """For each string, the index of the first glob that fits all of it, or -1."""
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = self.run(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths)
        found = np.full(len(strings), -1, np.int32)
        for k, (word, bit) in reversed(list(enumerate(self.last))):
            found[(ends[:, word] & bit) != 0] = k
        return found


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], keep: Sequence[str], url: str = "url", default: str = "allow") -> DataFrame:
    """``keep`` columns of ``pages`` with host, path, rule and verdict; the longest fitting rule decides.

    Of rules with equal length the one listed first decides. The rules are a parameter, so the automaton's size is fixed by it.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = GlobAutomaton([r.glob for r in ranked])
    sep = SEPARATOR

    def match(host: pd.Series, path: pd.Series) -> pd.Series:
        urls = [b"." + h.encode() + sep + p.encode() for h, p in zip(host, path)]
        return pd.Series(automaton.first_match(urls))

    found = F.pandas_udf(match, "int")
    named = pages.select(*keep, host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    hit = named.withColumn("_k", F.when((F.col("host") != "") | (F.col("path") != ""), found("host", "path")))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.when(F.col("_k") >= 0, F.col("_k"))) if values else F.lit(None).cast("string")
    return hit.select(
        *keep, "host", "path",
        pick([r.name for r in ranked]).alias("rule"),
        F.coalesce(pick([r.verdict for r in ranked]), F.lit(default)).alias("verdict"),
    )


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES, ["page_id"])


OP9_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(verdict, h, t) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT page_id, host, path, arg_max(h || t, length(h || t)) AS rule, arg_max(verdict, length(h || t)) AS verdict
  FROM (SELECT row_number() OVER () AS n, * FROM p) q
  LEFT JOIN r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.t)
  GROUP BY n, page_id, host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
"""
