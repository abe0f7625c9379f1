"""URL filters: host and path rules, and pattern rules found through their rarest literal token."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, batch

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    """Fits `host` and its subdomains where the path starts with `path`; of those that fit, the longest wins."""

    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """`pattern` is a regular expression on the lower-cased url; every url that it fits holds all `literals` as whole tokens."""

    pattern: str
    literals: tuple[str, ...]
    action: str = "block"


#: The rules of the query.
HOST_RULES = (HostRule("block", "net"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/"))
PATTERN_RULES = (
    PatternRule(r"://[^/?#]*\bfree-bets\b", ("free", "bets")),
    PatternRule(r"://[^/?#]*\bcheap-pills\b", ("cheap", "pills")),
    PatternRule(r"://[^/?#]*\b(?:online|best|live)-casino\b", ("casino",)),
    PatternRule(r"://[^/?#]*\bcasino-(?:online|bonus|games)\b", ("casino",)),
    PatternRule(r"://[^/?#]*\bpayday-loans?\b", ("payday",)),
    PatternRule(r"://[^/?#]*\b(?:xxx|porn)[.-]", ()),
    PatternRule(r"://[^/?#]*\badult-(?:cams?|chat|videos?)\b", ("adult",)),
    PatternRule(r"/wp-login\.php\b", ("wp", "login", "php")),
    PatternRule(r"[?&]affiliate_id=", ("affiliate", "id")),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both are empty for null and for a url without `://`."""
    i = url.find("://") if url else -1
    if i < 0:
        return "", ""
    rest = url[i + 3 :]
    m = re.match(r"[^/?#]*", rest)
    host = m.group().encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    tail = rest[m.end() :]
    return host, re.match(r"[^?#]*", tail).group()


class Index:
    """Host rules by host; pattern rules by their rarest literal, those without any in a list that every url runs."""

    def __init__(self, hosts: tuple[HostRule, ...], patterns: tuple[PatternRule, ...], frequency: dict[str, int]):
        self.hosts: dict[str, list[HostRule]] = defaultdict(list)
        for r in hosts:
            self.hosts[r.host].append(r)
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        self.rules = [(re.compile(p.pattern), p.action) for p in patterns]
        for i, p in enumerate(patterns):
            if p.literals:
                self.by_token[min(p.literals, key=lambda t: (frequency.get(t, 0), t))].append(i)
            else:
                self.always.append(i)

    def host_rule(self, host: str, path: str) -> HostRule | None:
        """The longest rule that fits (ties: by text); each suffix of the host is one lookup."""
        best, labels = None, host.split(".") if host else []
        for i in range(len(labels)):
            for r in self.hosts.get(".".join(labels[i:]), ()):
                if path.startswith(r.path) and (best is None or (len(r.text), r.text) > (len(best.text), best.text)):
                    best = r
        return best

    def candidates(self, url: str) -> list[int]:
        return sorted({*self.always, *(i for t in set(TOKEN.findall(url)) for i in self.by_token.get(t, ()))})

    def pattern_verdict(self, url: str | None) -> str:
        """block if a candidate that blocks fits and none that allows does; else allow."""
        if not url:
            return "allow"
        low, found = url.lower(), "allow"
        for i in self.candidates(low):
            rule, action = self.rules[i]
            if rule.search(low):
                if action == "allow":
                    return "allow"
                found = "block"
        return found

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = split_url(url)
        rule = self.host_rule(host, path)
        return host, path, rule.text if rule else None, rule.action if rule else self.pattern_verdict(url)


def token_frequency(pages: DataFrame, tokens: set[str], url_col: str = "url") -> dict[str, int]:
    """How many urls of the whole table hold each of the rules' tokens. The result is as small as the rule set."""
    if not tokens:
        return {}
    found = F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower(F.col(url_col)), F.lit("([a-z0-9]+)"), 1)), F.array(*map(F.lit, sorted(tokens))))
    return {r["t"]: r["n"] for r in pages.select(F.explode(found).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}


def url_filters(pages: DataFrame, hosts: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url", most_rules: int = 200_000) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict.

    A host rule that fits decides; else the pattern rules do. Null, empty or odd urls have an empty host and path,
    fit no host rule, and are allowed unless a pattern fits. Repeated rows are judged each; other columns are left
    aside. The rules travel with the tasks, so that more than `most_rules` of them are refused.
    """
    if len(hosts) + len(patterns) > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    frequency = token_frequency(pages, {t for p in patterns for t in p.literals}, url_col)
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(hosts, patterns, frequency)
        for b in it:
            cols = list(zip(*map(index.judge, b.column(1).to_pylist()), strict=True)) or [[]] * 4
            yield batch(**{id_col: b.column(0)}, **{k: pa.array(v, pa.string()) for k, v in zip(("host", "path", "rule", "verdict"), cols, strict=True)})

    return arrow_pass(pages.select(id_col, url_col), run, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")


def oracle(hosts: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES) -> str:
    """DuckDB SQL for the rows of url_filters over pages."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    fits = lambda r: f"((host = {q(r.host)} OR ends_with(host, {q('.' + r.host)})) AND starts_with(path, {q(r.path)}))"
    longest = sorted(hosts, key=lambda r: (-len(r.text), r.text))
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(r)} THEN {q(f(r))}" for r in longest)
    blocked = " OR ".join(f"regexp_matches(lower(coalesce(url, '')), {q(p.pattern)})" for p in patterns if p.action == "block") or "false"
    return f"""WITH cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(regexp_replace(coalesce(rest, ''), '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut)
SELECT page_id, host, path, {case(lambda r: r.text)} END AS rule, {case(lambda r: r.action)} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict FROM parts"""
