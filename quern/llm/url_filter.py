"""URL filter: host and path rules first, then a weighted vocabulary matched by one Aho-Corasick automaton.

A url is lower-cased (A-Z) and scanned once. A hit counts only where no ASCII letter or digit touches it on either
side. One strict term, or distinct soft terms whose weights add up to ``soft_limit``, block the url. Rules
override the vocabulary: a rule (host, path) fits its host and all subdomains if the url's path starts with the rule's
path; the longest rule wins (ties: the longer host).

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is judged by the
vocabulary alone (null: allow). Repeated rows are judged one by one. Columns of the input other than the url are passed
through; the five result columns replace input columns of the same name. The operator is map-only: no shuffle, so hot
hosts do not matter, and an empty table gives an empty result. Vocabulary and rules are broadcast
once per job and are bounded by ``MAX_TERMS`` and ``MAX_RULES``.
"""

from __future__ import annotations

import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import limit_batches, merge_splits, worker_state

#: The default vocabulary, a small one for the query. One strict term blocks; soft terms block when their weights
#: reach ``SOFT_LIMIT``. Larger vocabularies come as tables (``vocabulary``).
STRICT_TERMS = (
    "casino", "porn", "porno", "xxx", "viagra", "cialis", "escort", "escorts", "spam", "phishing", "warez", "keygen", "camgirls", "hentai", "milf", "onlyfans", "slots", "sportsbook", "betting", "gambling",
    "malware", "ransomware", "carding", "cvv", "torrent", "torrents", "nude", "nudes", "sexcam", "payday",
)
SOFT_TERMS = {
    "adult": 1.25, "crack": 1.25, "hack": 1.25, "pills": 1.25, "poker": 1.25, "bets": 1.0, "bet": 1.0, "bonus": 1.0, "cheap": 1.0, "farm": 1.0, "free": 1.0, "loan": 1.0, "loans": 1.0, "win": 1.0, "winner": 1.0,
    "ads": 1.0, "track": 1.0, "click": 0.75, "coupon": 0.75, "deal": 1.0, "deals": 0.75, "discount": 0.75, "download": 0.75, "jackpot": 1.25, "lottery": 1.25, "prize": 0.75, "promo": 0.75, "replica": 1.0,
    "sexy": 1.25, "dating": 0.75, "singles": 0.75, "hot": 0.5, "buy": 0.5, "now": 0.25, "sale": 0.5, "offer": 0.5, "best": 0.25, "rich": 0.5, "quick": 0.25, "cash": 0.75, "credit": 0.5, "debt": 0.75,
    "weight": 0.5, "loss": 0.5, "miracle": 1.0, "cure": 0.5, "leaked": 1.0, "pirated": 1.25, "serial": 0.75, "unlock": 0.5,
}
SOFT_LIMIT = 2.0
#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
MAX_TERMS, MAX_RULES = 200_000, 200_000
_UPPER = {c: c + 32 for c in range(65, 91)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` up to ``/ ? #`` or the end, A-Z lowered; path up to ``? #``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    stop = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return host.translate(_UPPER), path[:stop]


def vocabulary(terms: DataFrame) -> tuple[tuple[str, ...], dict[str, float]]:
    """(strict terms, soft terms with weights) of a table term, kind (strict or soft), weight; at most ``MAX_TERMS`` rows.

    Repeated terms count once: strict before soft, then with the largest weight; null and empty terms are left out.
    """
    rows = terms.where("term <> ''").groupBy("term").agg(F.max(F.col("kind") == "strict").alias("strict"), F.max("weight").alias("weight")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError("the vocabulary exceeds the bound for broadcasting")
    return tuple(sorted(r["term"] for r in rows if r["strict"])), {r["term"]: r["weight"] or 0.0 for r in rows if not r["strict"]}


class Vocabulary:
    """The automaton with the weights of its terms."""

    def __init__(self, strict, soft, soft_limit):
        self.soft_limit, self.auto = soft_limit, ahocorasick.Automaton()
        for t in strict:
            self.auto.add_word(t.translate(_UPPER), (t.translate(_UPPER), None))
        for t, w in soft.items():
            if t.translate(_UPPER) not in self.auto:
                self.auto.add_word(t.translate(_UPPER), (t.translate(_UPPER), w))
        if len(self.auto):
            self.auto.make_automaton()

    def hits(self, url: str | None) -> tuple[set[str], dict[str, float]]:
        strict, soft = set(), {}
        if url and len(self.auto):
            low = url.translate(_UPPER)
            for end, (term, w) in self.auto.iter(low):
                start = end - len(term) + 1
                if (start and low[start - 1] in _WORD) or (end + 1 < len(low) and low[end + 1] in _WORD):
                    continue
                if w is None:
                    strict.add(term)
                else:
                    soft[term] = w
        return strict, soft

    def blocks(self, url: str | None) -> bool:
        strict, soft = self.hits(url)
        return bool(strict) or sum(soft.values()) >= self.soft_limit


class Rules:
    """Host rules looked up by every suffix of the host, longest rule first."""

    def __init__(self, rules):
        self.by_host: dict[str, list] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host.translate(_UPPER), []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, host
        while at:
            for p, verdict in self.by_host.get(at, ()):
                key = (len(at) + len(p), len(at))
                if path.startswith(p) and (best is None or key > best[0]):
                    best = (key, at + p, verdict)
            _, _, at = at.partition(".")
        return best and best[1:]


class Judge:
    """The automaton and the rules, built once per Python worker and job."""

    def __init__(self, strict, soft, soft_limit, rules):
        self.parts = Vocabulary(strict, soft, soft_limit), Rules(rules)


RESULT = [("host", T.StringType()), ("path", T.StringType()), ("rule", T.StringType()), ("verdict", T.StringType()), ("terms", T.StringType())]


def url_filter(df: DataFrame, url: str = "url", strict=STRICT_TERMS, soft=None, soft_limit: float = SOFT_LIMIT, rules=RULES) -> DataFrame:
    """Adds host, path, rule (null if none fits), verdict (``allow`` or ``block``) and terms (sorted hits, comma-joined)."""
    soft = SOFT_TERMS if soft is None else soft
    if len(strict) + len(soft) > MAX_TERMS or len(rules) > MAX_RULES:
        raise ValueError("vocabulary or rules exceed the bound for broadcasting")
    new = [k for k, _ in RESULT]
    keep = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType(keep + [T.StructField(k, t) for k, t in RESULT])
    names = [f.name for f in keep]

    limit_batches(df.sparkSession)

    held = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, tuple(strict), dict(soft), soft_limit, tuple(rules)))

    def run(batches):
        vocabulary, table = worker_state(held, Judge).parts
        for b in batches:
            rows = []
            for u in b.column(b.schema.get_field_index(url)).to_pylist():
                host, path = split_url(u)
                rule, (s, w) = table.find(host, path), vocabulary.hits(u)
                verdict = rule[1] if rule else "block" if s or sum(w.values()) >= soft_limit else "allow"
                rows.append((host, path, rule[0] if rule else None, verdict, ",".join(sorted(s | set(w)))))
            cols = list(zip(*rows)) or [()] * len(new)
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(n)) for n in names] + [pa.array(c, pa.string()) for c in cols], names + new
            )

    return merge_splits(df).mapInArrow(run, schema)


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict", "terms")


def _oracle() -> str:
    strict = [f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')" for t in STRICT_TERMS]
    soft = [f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')" for t in SOFT_TERMS]
    names = sorted([*STRICT_TERMS, *SOFT_TERMS])
    terms = ", ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN '{t}' END" for t in names)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ranked = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ranked)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ranked)
    return f"""
WITH parts AS (
  SELECT page_id, {lower.format("coalesce(url, '')")} AS low,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, low, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM parts)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict}
    WHEN {" OR ".join(strict)} THEN 'block'
    WHEN {" + ".join(f"{w} * {x}::INT" for x, w in zip(soft, SOFT_TERMS.values(), strict=True))} >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
  concat_ws(',', {terms}) AS terms
FROM split"""


ORACLE = _oracle()
