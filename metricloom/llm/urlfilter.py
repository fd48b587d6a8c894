"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

One automaton over all terms reads each URL once. A hit counts where no letter or digit stands next to
it; one strict term rejects, and so do ``SOFT_HITS`` distinct soft ones.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged
by its words (null: none); repeated rows are each judged; an empty table gives an empty result.
"""

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed rules: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
STRICT = ("adult", "casino", "porn", "xxx", "bets", "betting", "gambling", "viagra", "escort", "warez")
SOFT = ("ads", "track", "tracker", "spam", "farm", "win", "free", "bonus", "cheap", "click", "promo", "popup", "redirect", "affiliate")
SOFT_HITS = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def vocabulary(strict: tuple[str, ...], soft: tuple[str, ...]):
    """A function of URLs that counts distinct strict and soft terms."""

    @F.pandas_udf("n_strict long, n_soft long")
    def counts(urls: pd.Series) -> pd.DataFrame:
        automaton = ahocorasick.Automaton()
        for word in {*strict, *soft}:
            automaton.add_word(word, word)
        automaton.make_automaton()
        letters, strict_, soft_ = set(_LOWER + "0123456789"), set(strict), set(soft)
        found = []
        for url in urls:
            url = url or ""
            hits = {
                word
                for end, word in automaton.iter(url)
                if (end + 1 == len(url) or url[end + 1] not in letters) and (end < len(word) or url[end - len(word)] not in letters)
            }
            found.append((len(hits & strict_), len(hits & soft_)))
        return pd.DataFrame(found, columns=["n_strict", "n_soft"])

    return counts


def judge(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_hits: int = SOFT_HITS
) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, n_strict, n_soft``. A rule fits its
    host and all subdomains where the path starts with the rule's; the longest one wins."""
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumn("host", host).withColumn("path", path)
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p) for _, h, p in ranked]
    rule = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, ranked, strict=True)])
    ruled = F.coalesce(*[F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, ranked, strict=True)])
    own = own.withColumn("rule", rule).withColumn("ruled", ruled)
    own = own.withColumn("n", vocabulary(strict, soft)(F.translate("url", _UPPER, _LOWER)))
    method = F.when((F.col("n.n_strict") > 0) | (F.col("n.n_soft") >= soft_hits), "block").otherwise("allow")
    return own.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "n.n_strict", "n.n_soft")
