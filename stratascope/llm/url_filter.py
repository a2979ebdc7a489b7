"""URL filters: allow and block rules first, then a weighted vocabulary found by Aho-Corasick.

A URL that no rule decides is blocked on one strict term, or when the weights of its distinct soft terms reach a limit.
A term counts only where neither neighbour is an ASCII letter or digit. Terms and URLs are compared with A-Z lower-cased.

Cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; the vocabulary still reads what
text there is. Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: Terms and rules travel to every task with the function, so their number is bounded.
MOST_TERMS = 200_000

# fixed values: default vocabulary
STRICT = ("casino", "escort", "gambling", "hentai", "poker", "porn", "viagra", "warez", "xxx")
SOFT = {"adult": 1.5, "bet": 1.5, "bonus": 1.0, "cheap": 1.0, "crack": 1.0, "dating": 1.0, "diet": 1.0, "farm": 1.0, "free": 1.0, "jackpot": 1.5, "loan": 1.0, "nude": 1.5, "pills": 1.0, "sex": 1.5, "slots": 1.5, "spam": 1.0, "win": 1.0}


@dataclass(frozen=True)
class UrlPolicy:
    rules: Sequence[Rule] = ()
    strict: Sequence[str] = STRICT
    soft: Mapping[str, float] = field(default_factory=lambda: dict(SOFT))
    soft_limit: float = 2.0

    def __post_init__(self):
        if len(self.rules) + len(self.strict) + len(self.soft) > MOST_TERMS:
            raise ValueError(f"a policy holds at most {MOST_TERMS} rules and terms")


def policy_from(terms: DataFrame, rules: Sequence[Rule] = (), soft_limit: float = 2.0) -> UrlPolicy:
    """A policy whose vocabulary is a table: term, kind (strict or soft) and the weight of soft terms.

    Null terms and kinds are left out, and of several weights for a term the largest counts; more than MOST_TERMS terms are
    refused before any is fetched.
    """
    own = terms.where("term IS NOT NULL AND term <> '' AND kind IN ('strict', 'soft')").groupBy(lower_ascii(F.col("term")).alias("term"), "kind").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    if own.count() > MOST_TERMS:
        raise ValueError(f"a policy holds at most {MOST_TERMS} rules and terms")
    rows = own.collect()  # MOST_TERMS at most
    return UrlPolicy(rules, tuple(sorted(r["term"] for r in rows if r["kind"] == "strict")), {r["term"]: float(r["weight"]) for r in sorted(rows) if r["kind"] == "soft"}, soft_limit)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _matcher(policy: UrlPolicy):
    """A function of a lower-case text: its distinct strict terms and its distinct soft terms."""
    terms = ahocorasick.Automaton()
    for t in {*policy.strict, *policy.soft}:
        terms.add_word(t.lower(), t.lower())
    terms.make_automaton()
    strict, soft = {t.lower() for t in policy.strict}, {t.lower() for t in policy.soft}
    inside = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

    def hits(text: str) -> tuple[set[str], set[str]]:
        found = set()
        if len(terms):
            for end, term in terms.iter(text):
                start = end - len(term)
                if (start < 0 or text[start] not in inside) and (end + 1 == len(text) or text[end + 1] not in inside):
                    found.add(term)
        return found & strict, found & soft

    return hits


def _ruler(policy: UrlPolicy):
    """A function of host and path: the longest rule that fits, or None."""
    by_host: dict[str, list[tuple[int, str, str, str]]] = {}
    for verdict, host, path in policy.rules:
        by_host.setdefault(host, []).append((len(host) + len(path), host, path, verdict))

    def rule(host: str, path: str):
        best, at = None, 0
        while True:
            for r in by_host.get(host[at:], ()):
                if path.startswith(r[2]) and (best is None or r > best):
                    best = r
            at = host.find(".", at) + 1
            if not at:
                return best

    return rule


def url_judgement(policy: UrlPolicy):
    """A Pandas UDF of (url, host, path): rule, verdict, strict_terms, soft_terms, soft_weight."""

    @F.pandas_udf("rule string, verdict string, strict_terms array<string>, soft_terms array<string>, soft_weight double")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        hits, rule = _matcher(policy), _ruler(policy)
        weights = {t.lower(): w for t, w in policy.soft.items()}
        for url, host, path in parts:
            out = []
            for u, h, p in zip(url, host, path):
                strict, soft = hits(u)
                weight, fits = sum(weights[t] for t in soft), rule(h, p)
                own = "block" if strict or (soft and weight >= policy.soft_limit) else "allow"
                out.append((fits and fits[1] + fits[2], fits[3] if fits else own, sorted(strict), sorted(soft), float(weight)))
            yield pd.DataFrame(out, columns=["rule", "verdict", "strict_terms", "soft_terms", "soft_weight"])

    return judge


def _judged(url: Column, policy: UrlPolicy) -> Column:
    return url_judgement(policy)(lower_ascii(F.coalesce(url, F.lit(""))), url_host(url), url_path(url))


def url_verdicts(pages: DataFrame, policy: UrlPolicy, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, strict_terms, soft_terms and soft_weight of every page."""
    u = F.col(f"`{url}`")
    return pages.select(F.col(f"`{page_id}`").alias("page_id"), url_host(u).alias("host"), url_path(u).alias("path"), _judged(u, policy).alias("j")).select("page_id", "host", "path", "j.*")


def allowed_pages(pages: DataFrame, policy: UrlPolicy, url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, with their own columns."""
    return pages.where(_judged(F.col(f"`{url}`"), policy).getField("verdict") == "allow")
