"""URL filter: rules on hosts and paths first, else a weighted vocabulary found by an Aho-Corasick automaton."""
from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Term -> weight. A strict term rejects alone, soft terms together.
STRICT_WEIGHT, SOFT_WEIGHT = 2, 1
STRICT_TERMS = ("adult", "porn", "xxx", "sex", "hentai", "escort", "camgirl", "warez", "phishing", "malware")
SOFT_TERMS = ("casino", "bet", "bets", "betting", "poker", "slots", "jackpot", "win", "bonus", "free", "cheap", "loan", "pills", "viagra", "dating",
              "ads", "track", "click", "popup", "crack", "torrent")
VOCABULARY = tuple((t, STRICT_WEIGHT) for t in STRICT_TERMS) + tuple((t, SOFT_WEIGHT) for t in SOFT_TERMS)
REJECT_FROM = 2


@lru_cache(maxsize=4)
def automaton(vocabulary: tuple[tuple[str, int], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in vocabulary:
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def _is_word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def hits(url: str, found) -> dict[str, int]:
    """Distinct terms of ``url`` (lower case) with no ASCII letter or digit at either side, and their weights."""
    out, last = {}, len(url) - 1
    for end, (term, weight) in found.iter(url):
        begin = end - len(term) + 1
        if (begin == 0 or not _is_word(url[begin - 1])) and (end == last or not _is_word(url[end + 1])):
            out[term] = weight
    return out


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url; both empty where it is null or has no ``://``."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.when(has, F.expr(f"substring({_name(url)}, locate('://', {_name(url)}) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return _ascii_lower(host), F.coalesce(path, F.lit(""))


def _name(c: Column) -> str:
    return c._jc.toString()


def judge(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", vocabulary=VOCABULARY, reject_from: int = REJECT_FROM) -> DataFrame:
    """Append host, path, rule, verdict, hit_terms and hit_weight to each row.

    ``rules`` holds (verdict, host, path prefix). A rule fits its host and every subdomain if the path begins with its
    path; the longest (host and path together, then host) wins. Without a rule, a url whose distinct terms weigh
    ``reject_from`` or more is blocked: one strict term or several soft ones. A null url fits nothing and is allowed.
    Columns of the input named like an output are replaced; repeated rows are judged one by one. No shuffle.
    """
    outputs = ["host", "path", "rule", "verdict", "hit_terms", "hit_weight"]
    df = df.drop(*[c for c in df.columns if c.lower() in outputs and c != url])
    host, path = host_and_path(F.col(url))
    df = df.withColumns({"host": host, "path": path})

    @F.pandas_udf("struct<hit_terms: array<string>, hit_weight: int>")
    def weigh(urls: pd.Series) -> pd.DataFrame:
        found = automaton(vocabulary)
        each = [hits(u, found) for u in urls.fillna("")]
        return pd.DataFrame({"hit_terms": [sorted(h) for h in each], "hit_weight": [sum(h.values()) for h in each]})

    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1])), reverse=True)
    rule = verdict = F.lit(None).cast("string")
    for what, at, begins in reversed(ordered):
        fits = (F.col("host") == at) | F.col("host").endswith("." + at)
        fits = fits & F.col("path").startswith(begins)
        rule, verdict = F.when(fits, at + begins).otherwise(rule), F.when(fits, what).otherwise(verdict)
    df = df.withColumn("_hits", weigh(_ascii_lower(F.col(url)))).withColumns({"rule": rule, "verdict": verdict})
    by_terms = F.when(F.col("_hits.hit_weight") >= reject_from, "block").otherwise("allow")
    return df.select("*", F.col("_hits.hit_terms"), F.col("_hits.hit_weight")).withColumn("verdict", F.coalesce("verdict", by_terms)).drop("_hits")
