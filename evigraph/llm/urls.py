"""URL filters: pattern rules indexed by their rarest literal token.

A rule names a host and a path prefix and becomes a regular expression over
``host + path``; other pattern rules can be given as regular expressions with
the literal tokens that they require.  Every rule is indexed by one of its
literal tokens, the one that the fewest URLs hold (counted over all URLs, ties
by name).  A URL's tokens fetch the candidate rules and only those run their
regular expression.  Rules without a literal token are candidates everywhere.

Rows are judged where they are: no shuffle, whatever the hosts' frequencies.
The index goes out with the tasks in blocks of at most ``max_rules`` rules; more
rules mean more passes over the same rows, each keeping the better rule so far.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
A-Z lower-cased; path: from there up to ``?``, ``#`` or the end.  Without
``://``, or for null, both are empty, no rule fits and the default holds.  Of
the fitting host rules the longest wins; without one, a fitting pattern rule
blocks; otherwise the row is allowed.  Of rules of one length, or
of several pattern rules, the first by name counts.  Equal rows, and rows with one page_id, are
judged one by one; very long urls are read whole; an empty table gives an empty
result.  Extra columns are carried along, whatever their names (host, path, rule
and verdict are replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import LOWER, UPPER, carried, own_names

TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str
    pattern: str
    tokens: tuple[str, ...] = field(default=())
    weight: int = 0  # host rules: their length; pattern rules: 0


def host_rule(verdict: str, text: str) -> Rule:
    """``example.org/es/``: the host, all its subdomains, and paths with this prefix."""
    host, slash, path = text.partition("/")
    tokens = re.findall(TOKEN, host) + re.findall(TOKEN, path)
    if path and re.fullmatch(r"[a-z0-9]", path[-1]):  # the last token may go on in the url
        tokens.pop()
    # tokens are case-sensitive like the path: those with other letters can't be looked up
    whole = [t for t in tokens if re.fullmatch(TOKEN, t)]
    if re.search("[A-Z]", path):
        whole = re.findall(TOKEN, host)
    return Rule(verdict, text, rf"(?s)^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(dict.fromkeys(whole)), len(text))


#: Host and path rules.
HOST_RULES = (
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
)
#: Pattern rules of the method, for hosts that sell or track.
PATTERN_RULES = (
    Rule("block", "cheap-pills", r"(?:^|[./-])cheap-pills(?:[./-]|$)", ("cheap", "pills")),
    Rule("block", "spam-farm", r"(?:^|[./-])spam-farm(?:[./-]|$)", ("spam", "farm")),
    Rule("block", "casino", r"(?:^|[./-])(?:online-)?casino(?:[./-]|$)", ("casino",)),
    Rule("block", "adserver", r"^(?:[^/]*\.)?(?:ads?|adserver|doubleclick)\d*\.", ()),
    Rule("block", "tracker", r"^(?:[^/]*\.)?(?:track|tracker|tracking)\.", ()),
)


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def token_counts(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; at most one row a token comes to the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(TOKEN), F.lit(0)))
    rows = urls.select(F.explode(F.array_intersect(tokens, F.lit(wanted))).alias("t")).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}


def judge(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, url: str = "url", max_rules: int = 20_000) -> DataFrame:
    """Adds host, path, rule (host rules only) and verdict."""
    host, path = split_url(F.col(url))
    kept = carried(pages, "host", "path", "rule", "verdict")
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    seen = token_counts(rows, rules)
    rarest = [min(r.tokens, key=lambda t: (seen.get(t, 0), t)) if r.tokens else None for r in rules]
    own = own_names(rows, "judged")[0]
    out = rows.withColumn(own, F.lit(None).cast(JUDGED))
    for first in range(0, len(rules), max_rules):
        judged = _matcher(rules[first : first + max_rules], rarest[first : first + max_rules])
        out = out.withColumn(own, judged("host", "path", f"{own}.best", f"{own}.weight", f"{own}.verdict"))
    verdict = F.coalesce(f"{own}.verdict", F.lit("allow"))
    return out.select(*kept, "host", "path", F.when(F.col(f"{own}.weight") > 0, F.col(f"{own}.best")).alias("rule"), verdict.alias("verdict"))


JUDGED = "struct<best: string, weight: int, verdict: string>"


def _matcher(rules: tuple[Rule, ...], keys: list[str | None]):
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        index: dict[str | None, list[tuple[int, re.Pattern, str, str]]] = {}
        for rule, key in zip(rules, keys, strict=True):
            index.setdefault(key, []).append((rule.weight, re.compile(rule.pattern), rule.name, rule.verdict))
        everywhere, tokens = index.pop(None, []), re.compile(TOKEN)
        for hosts, paths, best_, weight_, verdict_ in batches:
            best, weight, verdict = list(best_), list(weight_.fillna(-1).astype(int)), list(verdict_)
            for i, whole in enumerate(hosts + paths):
                keyed = [r for key in {*tokens.findall(whole), *tokens.findall(whole.lower())} for r in index.get(key, ())]
                for w, pattern, name, says in [*keyed, *everywhere] if whole else ():
                    # among pattern rules, all of one weight, the first name by code point counts
                    if (w > weight[i] or w == weight[i] and name < best[i]) and pattern.search(whole):
                        best[i], weight[i], verdict[i] = name, w, says
            yield pd.DataFrame({"best": pd.Series(best, dtype=object), "weight": pd.Series(weight, dtype="int32"), "verdict": pd.Series(verdict, dtype=object)})

    return F.pandas_udf(run, JUDGED)
