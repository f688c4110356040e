"""URL filters: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

A term counts where neither neighbour is an ASCII letter or digit. One strict term, or SOFT_HITS distinct soft terms, block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches

#: Terms that block alone.
STRICT = ("porn", "xxx", "casino", "viagra", "cialis", "spam", "malware", "phishing", "warez", "escort", "gambling", "poker", "jackpot", "hentai", "torrent")
#: Terms that block together.
SOFT = ("cheap", "pills", "pill", "win", "free", "bonus", "bet", "betting", "loan", "loans", "credit", "adult", "sex", "dating", "cash", "prize", "winner", "discount", "replica", "pharmacy", "drugs", "crack", "keygen", "slots", "farm", "deal", "deals")
SOFT_HITS = 2
#: Fixed values: (action, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = frozenset(_LOWER + "0123456789")
#: A-Z only: other letters keep their places, so that boundaries stay where they are.
_FOLD = str.maketrans(_UPPER, _LOWER)
_AUTOMATA: dict[tuple, object] = {}


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, with A-Z in lower case; "" without "://"."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end; "" without "://"."""
    tail = F.regexp_replace(_rest(url), r"^[^/?#]*", "")
    return F.coalesce(F.substring_index(F.substring_index(tail, "?", 1), "#", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    if (strict, soft) not in _AUTOMATA:
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, term in enumerate(soft):
            found.add_word(term, (i, len(term), False))
        for i, term in enumerate(strict):
            found.add_word(term, (len(soft) + i, len(term), True))
        if len(found):
            found.make_automaton()
        _AUTOMATA[strict, soft] = found
    return _AUTOMATA[strict, soft]


def judge(url: str | None, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[int, int]:
    """Distinct strict and soft terms of a URL, with A-Z in lower case and boundary checks."""
    machine = _automaton(strict, soft)
    if not url or not len(machine):
        return 0, 0
    text, hits, terms = url.translate(_FOLD), set(), set()
    for end, (term, size, is_strict) in machine.iter(text):
        start = end - size + 1
        if (start and text[start - 1] in _LETTERS) or text[end + 1 : end + 2] in _LETTERS:
            continue
        (hits if is_strict else terms).add(term)
    return len(hits), len(terms)


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS, url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, strict_terms, soft_terms) of every row.

    The longest fitting rule decides (of equal lengths the first listed); without one the vocabulary does. A null url,
    or one without "://", has an empty host and path, so no rule with a host fits it; a null url has no terms and is
    allowed, and the vocabulary reads any other url whole. A null key stays null, repeated rows stay repeated, an empty
    table gives an empty table, and other columns are not looked at.
    """
    bounded_batches(pages.sparkSession)
    strict, soft = tuple(dict.fromkeys(strict)), tuple(x for x in dict.fromkeys(soft) if x not in set(strict))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [judge(u, strict, soft) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "host", "path", "rule", "rule_verdict")), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], [key, "host", "path", "rule", "rule_verdict", "strict_terms", "soft_terms"])

    u = F.col("url")
    rows = pages.select(F.col(key), F.col(url).cast("string").alias("url")).withColumns({"host": host_of(u), "path": path_of(u)})
    ruled = action = None
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        ruled = (F.when if ruled is None else ruled.when)(fits, F.lit(host + path))
        action = (F.when if action is None else action.when)(fits, F.lit(verdict))
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"rule": none if ruled is None else ruled, "rule_verdict": none if action is None else action})
    kind = pages.schema[key].dataType.simpleString()
    counted = rows.mapInArrow(count, f"`{key}` {kind}, host string, path string, rule string, rule_verdict string, strict_terms long, soft_terms long")
    vocabulary = F.when((F.col("strict_terms") > 0) | (F.col("soft_terms") >= soft_hits), "block").otherwise("allow")
    return counted.select(key, "host", "path", "rule", F.coalesce("rule_verdict", vocabulary).alias("verdict"), "strict_terms", "soft_terms")


def url_sql() -> str:
    """DuckDB SQL of url_verdicts() over the view pages, with the default vocabulary; its rules are written out."""
    lower = f"'{_UPPER}', '{_LOWER}'"
    hit = lambda t: f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)"
    return f"""
WITH a AS (SELECT page_id, translate(coalesce(url, ''), {lower}) AS low, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), {lower}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT page_id, host, path, CASE
 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
 WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
 WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
 WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule,
 {' + '.join(hit(t) for t in STRICT)} AS strict_terms, {' + '.join(hit(t) for t in SOFT)} AS soft_terms FROM b)
SELECT page_id, host, path, rule, CASE rule
 WHEN 'com/en/' THEN 'block' WHEN 'example.com/en/7' THEN 'allow' WHEN 'net/de/' THEN 'allow' WHEN 'example.net/de/8' THEN 'block' WHEN 'org/es/' THEN 'block'
 ELSE CASE WHEN strict_terms > 0 OR soft_terms >= {SOFT_HITS} THEN 'block' ELSE 'allow' END END AS verdict, strict_terms, soft_terms FROM c"""
