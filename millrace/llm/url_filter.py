"""Filtering URLs with a weighted vocabulary and host rules.

A URL is judged in two steps.  Host and path *rules* come first: a rule fits
its host and every subdomain when the URL's path starts with the rule's path,
and the longest fitting rule decides.  URLs that no rule fits are judged by a
*weighted vocabulary*: one Aho-Corasick automaton finds every strict and soft
term in one pass over the URL; a hit counts only where the term is bounded by
something other than a letter or digit.  One strict term, or several
**distinct** soft terms, reject the URL.

Terms are data (``url_terms.txt``).  A few host rules are a constant of the plan; more of them, or a table of
rules, are joined by the suffixes of the hosts.

Defined results: a null URL, or one without ``://``, has an empty host
and path, fits no rule and is allowed unless its text holds rejected terms (a
null holds none).  Of equally long rules the first by name decides, of rules alike one that allows.  Whole URLs are read,
however long; repeated rows are judged alike; an empty table gives no rows; other columns are kept, and those named
like a result are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from importlib import resources
from pathlib import Path

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: rules up to which they are a constant of the plan; more are joined
INLINE_RULES = 256


@dataclass(frozen=True)
class Rule:
    """``action`` ("allow" or "block") for ``host`` and its subdomains, below ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def read_terms(path: str | Path | None = None) -> dict[str, tuple[str, ...]]:
    """Terms by kind from a text file (the package's own, if none): ``[kind]`` lines, then words."""
    text = Path(path).read_text() if path else resources.files(__package__).joinpath("url_terms.txt").read_text()
    out: dict[str, list[str]] = {}
    for line in text.splitlines():
        if line.startswith("["):
            words = out.setdefault(line.strip("[] "), [])
        elif line and not line.startswith("#"):
            words += line.split()
    return {kind: tuple(dict.fromkeys(words)) for kind, words in out.items()}


_TERMS = read_terms()


@dataclass(frozen=True)
class Vocabulary:
    """Strict terms weigh enough to reject alone, soft ones only together."""

    strict: tuple[str, ...] = _TERMS["strict"]
    soft: tuple[str, ...] = _TERMS["soft"]
    #: distinct soft terms that reject a URL
    soft_needed: int = 2


@dataclass(frozen=True)
class UrlPolicy:
    #: rules: a few, or a table (host, path, action)
    rules: tuple[Rule, ...] | DataFrame = ()
    vocabulary: Vocabulary = field(default_factory=Vocabulary)


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


_RULE = "struct<host:string,path:string,action:string>"


def suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def longest_fit(path: Column, rules: Column) -> Column:
    """Of an array of rules for a host, the longest whose path fits, as struct(name, action); of equally long ones the first by name."""
    fitting = F.transform(
        F.filter(rules, lambda r: path.startswith(r.path)),
        lambda r: F.struct((-F.length(F.concat(r.host, r.path))).alias("n"), F.concat(r.host, r.path).alias("name"), r.action.alias("action")),
    )
    best = F.array_min(fitting)
    return F.when(best.isNotNull(), F.struct(best["name"].alias("name"), best["action"].alias("action")))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as struct(name, action); null if none does.  ``rules`` is a constant of the plan."""
    table = F.from_json(F.lit(json.dumps([{"host": r.host, "path": r.path, "action": r.action} for r in rules])), f"array<{_RULE}>")
    known = suffixes(host)
    return longest_fit(path, F.filter(table, lambda r: F.array_contains(known, r.host)))


def with_rules(df: DataFrame, host: str, path: str, rules: DataFrame, to: str) -> DataFrame:
    """Add the longest fitting rule of a table (host, path, action) of any size.

    Distinct hosts are joined with the rules by each of their suffixes; rows then find the rules of their
    host.  Both joins are shuffles that adaptive execution may split or broadcast by measured size.
    """
    hosts = df.select(F.col(host).alias("h")).distinct().withColumn("suffix", F.explode(suffixes(F.col("h"))))
    found = hosts.join(rules.select("host", "path", "action").distinct(), F.col("suffix") == F.col("host"))
    by_host = found.groupBy("h").agg(F.collect_list(F.struct("host", "path", "action")).alias("rules"))
    key, held = unused(df, "h"), unused(df, "rules")
    joined = df.join(by_host.select(F.col("h").alias(key), F.col("rules").alias(held)), F.col(host) == F.col(key), "left")
    return joined.withColumn(to, longest_fit(F.col(path), F.col(held))).drop(key, held)


def term_counts(text: Column, vocabulary: Vocabulary) -> Column:
    """struct(strict, soft): distinct strict and soft terms in ``text``, by Aho-Corasick."""
    kinds = {t: "soft" for t in vocabulary.soft} | {t: "strict" for t in vocabulary.strict}

    @F.pandas_udf("strict int, soft int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for term, kind in kinds.items():
            automaton.add_word(term, (term, kind))
        automaton.make_automaton()
        for urls in batches:
            rows = []
            for url in urls:
                seen: dict[str, set] = {"strict": set(), "soft": set()}
                for end, (term, kind) in automaton.iter(url or ""):
                    start = end - len(term)
                    free_left = start < 0 or not url[start].isalnum()
                    if free_left and (end + 1 == len(url) or not url[end + 1].isalnum()):
                        seen[kind].add(term)
                rows.append((len(seen["strict"]), len(seen["soft"])))
            yield pd.DataFrame(rows, columns=["strict", "soft"]).astype("int32")

    return count(F.coalesce(F.lower(text), F.lit("")))


def judge(df: DataFrame, url_col: str = "url", policy: UrlPolicy = UrlPolicy(), prefix: str = "") -> DataFrame:
    """Add host, path, rule, strict_hits, soft_hits and verdict to every row."""
    names = [prefix + n for n in ("host", "path", "rule", "strict_hits", "soft_hits", "verdict")]
    host, path, rule, strict, soft, verdict = names
    own = [c for c in df.columns if c not in names]
    url = F.col(f"`{url_col}`")
    if url_col in names:  # a result takes its place
        raise ValueError(f"column {url_col} is named like a result; give a prefix")
    terms, found = unused(df, "terms"), unused(df, "found")
    step = df.select(*[F.col(f"`{c}`") for c in own], host_of(url).alias(host), path_of(url).alias(path), term_counts(url, policy.vocabulary).alias(terms))
    if isinstance(policy.rules, tuple) and len(policy.rules) <= INLINE_RULES:
        step = step.withColumn(found, matching_rule(F.col(host), F.col(path), policy.rules))
    else:
        rules = policy.rules
        if isinstance(rules, tuple):
            rules = df.sparkSession.createDataFrame([(r.host, r.path, r.action) for r in rules], "host string, path string, action string")
        step = with_rules(step, host, path, rules, found)
    bad = (F.col(terms).strict > 0) | (F.col(terms).soft >= policy.vocabulary.soft_needed)
    return step.select(
        *[F.col(f"`{c}`") for c in own],
        host,
        path,
        F.col(found)["name"].alias(rule),
        F.col(terms)["strict"].alias(strict),
        F.col(terms)["soft"].alias(soft),
        F.coalesce(F.col(found)["action"], F.when(bad, "block").otherwise("allow")).alias(verdict),
    )
