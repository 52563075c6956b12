"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host rule (a host with all its subdomains, and the start of a path)
or a pattern in the usual filter syntax: `||` the start of a host or subdomain,
`|` the start or end, `^` a separator or the end, `*` anything.  Each rule knows
the literal tokens (runs of letters and digits) that any url it fits must hold as
whole tokens.  One pass counts those tokens over all urls, each rule is indexed
by its rarest, and a url fetches by its own tokens the few rules whose regular
expressions then run.  Rules without a sure token run always.

Verdict: that of the longest host rule that fits; else allow if an exception
pattern fits, block if a pattern does, and allow.

Defined results: a null url, or one without `://`, has an empty host and path,
fits no rule and is allowed; repeated rows and null page_ids each get their row.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, texts

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)
TOKEN = re.compile(r"[a-z0-9]+")

#: (verdict, host, start of the path)
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The list that the query uses, beside this module: a pattern a line, `@@` before those that allow.
LIST = os.path.join(os.path.dirname(os.path.abspath(__file__)), "url_patterns.txt")
#: Rules are a parameter and are broadcast, up to so many characters of patterns.
MOST_CHARS = 32 << 20


def parse_list(lines: Iterable[str]) -> list[tuple[str, str]]:
    """(verdict, pattern) of the lines of a filter list; empty lines and comments (`!`) are passed over."""
    kept = (x.strip() for x in lines)
    return [("allow", x[2:]) if x.startswith("@@") else ("block", x) for x in kept if x and not x.startswith("!")]


def read_list(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """parse_list() of a list in any store that Spark reads."""
    return parse_list(r["value"] for r in spark.read.text(path).collect())


def own_list() -> list[tuple[str, str]]:
    with open(LIST, encoding="utf-8") as f:
        return parse_list(f)


#: (verdict, pattern); a block pattern gives way to an allow pattern.
PATTERNS = tuple(own_list())


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z in lower case, and path; both empty without `://`."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    path = rest[end:]
    stop = min((k for k in map(path.find, "?#") if k >= 0), default=len(path))
    return rest[:end].translate(ASCII_LOWER), path[:stop]


@dataclass(frozen=True)
class Rule:
    """name: of a host rule its host and path, of a pattern its text."""

    name: str
    verdict: str
    regex: str  # over the url in lower case; of a host rule over host + path
    tokens: tuple[str, ...]
    by_host: bool


def host_rule(verdict: str, host: str, path: str) -> Rule:
    # tokens are looked up by those of the url in lower case, a path is compared as it is
    tokens = TOKEN.findall(host) + _sure(path.translate(ASCII_LOWER), open_end=True)
    return Rule(host + path, verdict, rf"\A(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), True)


def _sure(pattern: str, open_end: bool) -> list[str]:
    """Literal tokens that stand whole in whatever the pattern fits: both sides
    are a literal that is no letter or digit, a separator or an anchor."""
    out = []
    for m in TOKEN.finditer(pattern):
        before = pattern[m.start() - 1] if m.start() else "*"
        after = pattern[m.end()] if m.end() < len(pattern) else "*" if open_end else "^"
        if before != "*" and after != "*":
            out.append(m[0])
    return out


def pattern_rule(verdict: str, pattern: str) -> Rule:
    out, k, p = "", 0, pattern.translate(ASCII_LOWER)
    while k < len(p):
        if p.startswith("||", k) and k == 0:
            out, k = r"\A[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", 2
            continue
        c = p[k]
        out += r"\A" if c == "|" and k == 0 else r"\z" if c == "|" and k == len(p) - 1 else r"(?:[^a-z0-9_.%-]|\z)" if c == "^" else ".*" if c == "*" else re.escape(c)
        k += 1
    return Rule(pattern, verdict, out, tuple(_sure(p, open_end=True)), False)


def rules(hosts: Iterable[tuple[str, str, str]] = HOST_RULES, patterns: Iterable[tuple[str, str]] = PATTERNS) -> list[Rule]:
    return [host_rule(*h) for h in hosts] + [pattern_rule(*p) for p in patterns]


class Index:
    """Rules by their rarest token, given how many urls hold each."""

    def __init__(self, all_rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = defaultdict(list)
        self.always: list[tuple[Rule, re.Pattern]] = []
        for r in all_rules:
            ready = (r, re.compile(r.regex.replace(r"\z", r"\Z"), re.S))
            if r.tokens:
                self.by_token[min(r.tokens, key=lambda t: (counts.get(t, 0), t))].append(ready)
            else:
                self.always.append(ready)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """host, path, host rule, verdict, and the pattern that decided."""
        host, path = split_url(url)
        rule, allow, block = None, None, None
        if host or path or (url and "://" in url):
            low = url.translate(ASCII_LOWER)
            found = list(self.always)
            for t in set(TOKEN.findall(low)):
                found += self.by_token.get(t, ())
            for r, regex in found:
                if r.by_host:
                    if regex.match(host + path) and (rule is None or (len(r.name), r.name) > (len(rule.name), rule.name)):
                        # the path begins where the host ends
                        if path.startswith(r.name[r.name.index("/") :]) and re.search(rf"(?:\A|\.){re.escape(r.name[: r.name.index('/')])}\Z", host):
                            rule = r
                elif regex.search(low):
                    if r.verdict == "allow":
                        allow = min(r.name, allow or r.name)
                    else:
                        block = min(r.name, block or r.name)
        if rule:
            return host, path, rule.name, rule.verdict, None
        return host, path, None, "block" if block and not allow else "allow", allow or block


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many urls hold each of the rules' tokens; a row for each token at most comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = dict.fromkeys(sorted(tokens), 0)
        for b in batches:
            for url in texts(b.column(0)):
                for t in tokens.intersection(TOKEN.findall(url.translate(ASCII_LOWER))):
                    n[t] += 1
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["token", "n"])

    rows = urls.mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def judged(pages: DataFrame, all_rules: list[Rule] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern."""
    all_rules = rules() if all_rules is None else all_rules
    if sum(len(r.name) + len(r.regex) for r in all_rules) > MOST_CHARS:
        raise ValueError(f"rules of more than {MOST_CHARS} characters")
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    index = pages.sparkSession.sparkContext.broadcast((all_rules, token_counts(urls.select("url"), {t for r in all_rules for t in r.tokens})))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(*index.value)
        for b in chunks(batches):
            rows = [own.judge(u) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))], ["page_id", "host", "path", "rule", "verdict", "pattern"])

    return urls.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, pattern string")


def oracle(hosts: Iterable[tuple[str, str, str]] = HOST_RULES, patterns: Iterable[tuple[str, str]] = PATTERNS) -> str:
    """SQL for judged()."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    ordered = sorted(hosts, key=lambda h: (-len(h[1] + h[2]), h[1] + h[2]))
    fits = lambda h: f"((host = {quoted(h[1])} or ends_with(host, {quoted('.' + h[1])})) and starts_with(path, {quoted(h[2])}))"
    rule = "case " + " ".join(f"when {fits(h)} then {quoted(h[1] + h[2])}" for h in ordered) + " end"
    said = "case " + " ".join(f"when rule = {quoted(h[1] + h[2])} then {quoted(h[0])}" for h in ordered)
    made = [pattern_rule(*p) for p in patterns]
    best = lambda verdict: "least(" + ", ".join(f"case when regexp_matches(low, {quoted('(?s)' + r.regex.replace(chr(92) + 'A', '^'))}) then {quoted(r.name)} end" for r in made if r.verdict == verdict) + ", null)"
    return f"""
with cut as (select page_id::bigint as page_id, case when contains(url, '://') then url end as u,
        case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as rest from pages),
parts as (select page_id, translate(u, '{_UPPER}', '{_LOWER}') as low, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
ruled as (select *, {rule} as rule, {best("allow")} as a, {best("block")} as b from parts)
select page_id, host, path, rule, {said} when b is not null and a is null then 'block' else 'allow' end as verdict,
    case when rule is null then coalesce(a, b) end as pattern from ruled"""
