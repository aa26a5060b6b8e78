"""URL filters over an index of rare literal tokens.

A rule is a host and a path prefix. Its regular expression is long to try on every url, so each rule is filed under
the rarest of its literal tokens (host labels, path segments), rarest in the urls at hand. A url's own tokens fetch
the few rules filed under them, and only those expressions run. Everything is DataFrame functions.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule. Of the rules that
fit, the longest host + path wins; between equal texts a block wins. Repeated rows are judged alone; of extra columns
those named host, path, rule or verdict are replaced, others stay; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[./]"
RULE_TYPE = "array<struct<token:string,rule:string,on_host:string,on_path:string,verdict:string,size:int>>"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def on_host(self) -> str:
        """The host or a subdomain of it."""
        return rf"(?s)\A(?:.*\.)?{re.escape(self.host)}\z"

    @property
    def on_path(self) -> str:
        return rf"\A{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Literals that any fitting url has too, cut as urls are. The path's last one may go on in the url."""
        return sorted({*re.split(TOKEN, self.host), *re.split(TOKEN, self.path)[:-1]} - {""})


#: Fixed values of the query.
RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def split_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    host, path = host_path(F.col(url))
    return pages.withColumns({"host": host, "path": path})


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.concat_ws("/", host, path), TOKEN))


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """Urls that hold each token of the rules, by one aggregate. The result has a row for each token of a rule."""
    known = sorted({t for r in rules for t in r.tokens})
    hits = urls.select(F.explode(F.array_intersect(tokens_of(F.col("host"), F.col("path")), F.array(*map(F.lit, known)))).alias("token"))
    return {t: 0 for t in known} | {r.token: r.n for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}


def index_rows(rules: list[Rule], counts: dict[str, int]) -> list[dict]:
    """Each rule under its rarest token; between equal counts the first token by name."""
    out = []
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.text!r} has no literal token")
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
        out.append({"token": token, "rule": r.text, "on_host": r.on_host, "on_path": r.on_path, "verdict": r.verdict, "size": len(r.text)})
    return out


def _best(found: Column) -> Column:
    """The longest; a block before an allow (b > a)."""
    return F.array_max(F.transform(found, lambda r: F.struct(r["size"].alias("size"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))


def judge(pages: DataFrame, rules: list[Rule] = RULES, url: str = "url", default: str = "allow", inline: int = 2000) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Up to ``inline`` rules travel as a constant inside the plan, and no row moves. More rules become a table joined
    on the token: its distinct urls carry tokens to the rules, so a host with a third of all pages is one row a url.
    """
    urls = split_urls(pages, url)
    rows = index_rows(rules, token_counts(urls, rules)) if rules else []
    fits = lambda r: F.rlike("host", r["on_host"]) & F.rlike("path", r["on_path"])
    if len(rows) <= inline:
        lists: dict[str, list[dict]] = {}
        for r in rows:
            lists.setdefault(r["token"], []).append(r)
        if not lists:
            return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
        index = F.from_json(F.lit(json.dumps(lists)), f"map<string,{RULE_TYPE}>")
        mine = F.array_intersect(tokens_of(F.col("host"), F.col("path")), F.map_keys(index))
        fetched = F.flatten(F.transform(mine, lambda t: F.element_at(index, t)))
        best = _best(F.filter(fetched, fits))
        out = urls.withColumn("__best", best)
    else:
        spark = pages.sparkSession
        table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), RULE_TYPE)).alias("r")).select("r.*")
        distinct = urls.select("host", "path").distinct()
        fetched = distinct.withColumn("token", F.explode(tokens_of(F.col("host"), F.col("path")))).join(table, "token").filter(fits({c: F.col(c) for c in ("on_host", "on_path")}))
        best = fetched.groupBy("host", "path").agg(F.max(F.struct("size", "verdict", "rule")).alias("__best"))
        out = urls.join(best, ["host", "path"], "left")
    return out.withColumns({"rule": F.col("__best.rule"), "verdict": F.coalesce(F.col("__best.verdict"), F.lit(default))}).drop("__best")


def fits_sql(rules: list[Rule]) -> str:
    """DuckDB text of the winner for columns host and path, by trying every rule: what the index must agree with."""
    order = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block"))
    one = lambda r: f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN "
    return "CASE " + " ".join(one(r) + f"'{r.text}'" for r in order) + " END rule, CASE " + " ".join(one(r) + f"'{r.verdict}'" for r in order) + " ELSE 'allow' END verdict"


ORACLE = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path FROM r)
SELECT page_id, host, path, {fits_sql(RULES)} FROM h
"""

__all__ = ["ORACLE", "RULES", "Rule", "fits_sql", "host_path", "index_rows", "judge", "split_urls", "token_counts", "tokens_of"]
