"""URL filter: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over ``host + path`` with the literal tokens that any match must hold whole. A first pass
counts how often the rules' tokens occur in the URLs; every rule is then filed under its rarest token. The second pass looks
up each URL's tokens in that index and runs only the regular expressions found there (and those of rules without a token).

Rules are sent to the tasks in blocks of at most ``BLOCK_BYTES``; more rules make more passes over the rows in the same
stage, never a dropped rule. No row is shuffled but the token counts, of which there are no more than rule tokens.

Rules may come from a table (``rules_from``): list rules of a host and a path, domains, wildcards, phrases or regular
expressions.

Defined cases: null URLs and URLs without ``://`` have empty host and path, fit no rule with a host and are allowed;
repeated rows stay; very long URLs are judged whole; of rules that weigh the same the smaller name wins; an empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookupforge.llm.common import bound_batches

BLOCK_BYTES = 4 << 20
_TOKEN = re.compile(r"[a-z0-9]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``weight`` decides between fitting rules (more wins, then the smaller name); ``listed`` rules beat others."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = field(default=())
    weight: int = 0
    listed: bool = False


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for ``host``, its subdomains and paths that start with ``path`` (case counts in the path)."""
    tokens = _TOKEN.findall(host.lower())
    whole = path[: path.rfind("/") + 1] if "/" in path else ""  # after the last slash a token may go on in the URL
    tokens += _TOKEN.findall(whole.lower())
    return Rule(host + path, verdict, r"\A(?:[^/]*\.)?" + re.escape(host + path), tuple(tokens), len(host + path), True)


def word_rule(verdict: str, word: str) -> Rule:
    """Hosts or paths with the hyphenated phrase ``word`` standing as whole tokens."""
    return Rule(f"word:{word}", verdict, rf"(?i)(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])", tuple(_TOKEN.findall(word.lower())), 0)


def wildcard_rule(verdict: str, pattern: str) -> Rule:
    """``*`` stands for any run of characters; the pattern covers host and path from the host's start (or a subdomain's)."""
    parts = [re.escape(x) for x in pattern.split("*")]
    whole = [t for x in pattern.lower().split("*") for t in re.findall(r"(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])", x)]
    return Rule(f"wildcard:{pattern}", verdict, r"\A(?:[^/]*\.)?" + ".*".join(parts), tuple(whole), len(pattern))


def regex_rule(verdict: str, pattern: str, tokens: str) -> Rule:
    """A regular expression over host and path; ``tokens`` (space-separated) are what any match must hold whole."""
    return Rule(f"regex:{pattern}", verdict, pattern, tuple(tokens.lower().split()), 0)


def rules_from(rows: Iterable[tuple[str, str, str, str]]) -> Iterator[Rule]:
    """Rules of (kind, verdict, value, more): ``prefix`` (host, path), ``domain`` (host), ``wildcard`` (pattern), ``phrase``
    (words) and ``regex`` (pattern, tokens); ValueError for another kind."""
    for kind, verdict, value, more in rows:
        if kind == "prefix":
            yield prefix_rule(verdict, value, more or "")
        elif kind == "domain":
            yield Rule(f"domain:{value}", verdict, r"\A(?:[^/]*\.)?" + re.escape(value) + r"(?:[:/]|\Z)", tuple(_TOKEN.findall(value.lower())), len(value))
        elif kind == "wildcard":
            yield wildcard_rule(verdict, value)
        elif kind == "phrase":
            yield word_rule(verdict, value)
        elif kind == "regex":
            yield regex_rule(verdict, value, more or "")
        else:
            raise ValueError(f"unknown kind of rule {kind!r}")


#: The list rules of the query, and the method's own pattern rules for URLs that no list rule fits. Fixed values.
LIST_RULES = (
    prefix_rule("allow", "org", "/"),
    prefix_rule("block", "example.org", "/es/"),
    prefix_rule("block", "example.org", "/en/1"),
    prefix_rule("allow", "com", "/fr/"),
    prefix_rule("block", "com", "/de/"),
)
PATTERN_RULES = tuple(word_rule("block", w) for w in ("cheap-pills", "spam-farm", "casino", "adult", "porn", "viagra", "xxx", "torrent", "free-money", "click-bait", "link-farm"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(_UPPER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """The same host as a Column."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall((host + path).lower()))


class RuleIndex:
    """Rules by their rarest token, given the tokens' counts in the corpus."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list] = defaultdict(list)
        self.always: list = []
        for r in rules:
            to = self.by_token[min(r.tokens, key=lambda t: (counts.get(t, 0), t))] if r.tokens else self.always
            to.append((r, re.compile(r.pattern)))

    def candidates(self, host: str, path: str) -> list:
        found = list(self.always)
        for t in url_tokens(host, path):
            found += self.by_token.get(t, ())
        return found

    def best(self, host: str, path: str) -> Rule | None:
        text = host + path
        fit = [r for r, p in self.candidates(host, path) if p.search(text)]
        return max(fit, key=_rank, default=None)


def _rank(r: Rule) -> tuple:
    return r.listed, r.weight, [-ord(c) for c in r.name]


def _count_tokens(batches: Iterator[pa.RecordBatch], wanted: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: Counter[str] = Counter()
        for host, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n.update(url_tokens(host, path) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])


def _judge(batches: Iterator[pa.RecordBatch], rules: list[Rule], counts: dict[str, int], names: list[str]) -> Iterator[pa.RecordBatch]:
    index = RuleIndex(rules, counts)
    for b in batches:
        best = []
        held = b.column(4).to_pylist()  # the earlier blocks' best: (listed, weight, name, verdict)
        for h, p, was in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), held, strict=True):
            r = index.best(h, p)
            now = None if r is None else {"listed": r.listed, "weight": r.weight, "name": r.name, "verdict": r.verdict}
            if was is not None and (now is None or _rank(Rule(was["name"], "", "", (), was["weight"], was["listed"])) >= _rank(r)):
                now = was
            best.append(now)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(best, _BEST)], names=names)


_BEST = pa.struct([("listed", pa.bool_()), ("weight", pa.int32()), ("name", pa.string()), ("verdict", pa.string())])


def judge_urls(pages: DataFrame, rules: Iterable[Rule], key: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """(key, url, host, path, rule, listed, verdict): the best fitting rule's verdict, ``otherwise`` where none fits."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    blocks, size = [[]], 0
    for r in rules:
        size += len(r.pattern) + len(r.name)
        if size > BLOCK_BYTES and blocks[-1]:
            blocks.append([])
            size = len(r.pattern) + len(r.name)
        blocks[-1].append(r)
    best = "struct<listed:boolean,weight:int,name:string,verdict:string>"
    out = rows.withColumn("best", F.lit(None).cast(best))
    kind = rows.schema["key"].dataType.simpleString()
    for block in blocks:
        wanted = frozenset(t for r in block for t in r.tokens)
        counts = {}
        if wanted:
            seen = rows.select("host", "path").mapInArrow(lambda it, w=wanted: _count_tokens(it, w), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
            counts = {r.token: r.n for r in seen.collect()}  # at most the block's own tokens
        out = out.mapInArrow(lambda it, b=block, c=counts: _judge(it, b, c, ["key", "url", "host", "path", "best"]), f"key {kind}, url string, host string, path string, best {best}")
    return out.select(F.col("key").alias(key), "url", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.listed", F.lit(False)).alias("listed"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


def op7_url_rules(spark, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the list rules, and by the pattern rules where none of those fits."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = judge_urls(pages, (*LIST_RULES, *PATTERN_RULES))
    return found.select("page_id", "host", "path", F.when(F.col("listed"), F.col("rule")).alias("rule"), "verdict", F.when(~F.col("listed"), F.col("rule")).alias("pattern_rule"))


_HOST = r"translate(case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*', 0) else '' end, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end"
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
r(verdict, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
w(word) AS (VALUES {", ".join(f"('{r.name[5:]}')" for r in PATTERN_RULES)}),
f AS (SELECT *, row_number() OVER () AS k FROM p)
SELECT f.page_id, f.host, f.path,
  (SELECT arg_max(r.h || r.q, length(r.h || r.q)) FROM r WHERE (f.host = r.h OR f.host LIKE '%.' || r.h) AND starts_with(f.path, r.q)) AS rule,
  coalesce((SELECT arg_max(r.verdict, length(r.h || r.q)) FROM r WHERE (f.host = r.h OR f.host LIKE '%.' || r.h) AND starts_with(f.path, r.q)),
    CASE WHEN EXISTS (SELECT 1 FROM w WHERE regexp_matches(f.host || f.path, '(?i)(^|[^a-z0-9])' || w.word || '($|[^a-z0-9])')) THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN NOT EXISTS (SELECT 1 FROM r WHERE (f.host = r.h OR f.host LIKE '%.' || r.h) AND starts_with(f.path, r.q))
    THEN (SELECT min('word:' || w.word) FROM w WHERE regexp_matches(f.host || f.path, '(?i)(^|[^a-z0-9])' || w.word || '($|[^a-z0-9])')) END AS pattern_rule
FROM f
"""
