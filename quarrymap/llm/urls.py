"""URL filters: host and path rules, then pattern rules indexed by their rarest literal token.

The longest fitting host and path rule gives the verdict. Only URLs that none fits are put to the pattern rules, which are
written as in filter lists: literal text, ``*`` for any run, ``^`` for a separator or the end, ``||`` for the beginning of a
host or of one of its parent domains, ``|`` for either end. A rule's literal tokens are the runs of letters and digits that
are bounded on both sides by something that is none, so that every match has them as whole tokens. Each rule is filed under
that of its tokens which the fewest rules have; a URL's tokens fetch the rules that could match, and only their regular
expressions are run. Rules without such a token are run on every URL. Any match blocks.

Null URLs and those without ``://`` have empty host and path, no rule, and are allowed. Rules of one length that both fit can
only be the same rule; of repeated ones the first verdict in alphabetical order counts. Repeated rows are judged alike, very
long URLs in time in proportion to them; an empty table gives an empty one. Other columns pass through, and columns of the
result's names are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import partial
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymap.llm.arrow import with_python
from quarrymap.session import table

#: (host and path, verdict) in any order.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Words that mark a junk site or path by themselves, and pairs of words that do so together.
JUNK = (
    "casino poker roulette jackpot lottery betting sportsbook viagra cialis levitra pills xxx porn porno hentai camgirls escorts payday warez keygen cracks malware phishing scareware "
    "clickbait popunder popads adserver adserv doubleclick spam spamfarm linkfarm"
).split()
FIRST = "free cheap easy fast hot best win big adult live casino spam click link ads ad buy replica fake miracle bonus secret".split()
SECOND = "money cash bets bet pills meds spins slots win loans x cams farm farms bait track tracker banner watches followers cure diet code".split()
EDGES = list(product("./-", "./-"))
#: Some fourteen thousand rules: every word and pair between any two of the edges.
PATTERNS = [
    *(f"{a}{w}{b}" for w in JUNK for a, b in EDGES),
    *(f"{a}{v}{joint}{w}{b}" for v, w, joint in product(FIRST, SECOND, ("-", "_", "")) for a, b in EDGES),
    "free-money",
    "/track/pixel",
]
_UPPER = {c: c + 32 for c in range(65, 91)}
_TOKENS = re.compile(r"[a-z0-9]+")


def parts(url: str | None) -> tuple[str, str]:
    """The host, A-Z lower-cased, and the path of a URL; both empty if it has no ``://``."""
    _, there, rest = (url or "").partition("://")
    if not there:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(_UPPER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_index(rules) -> dict[str, list[tuple[str, str, str]]]:
    """The rules of each host, the longest path first."""
    out = defaultdict(list)
    for rule, verdict in sorted(rules):
        host, slash, path = rule.partition("/")
        out[host].append((slash + path, rule, verdict))
    return {host: sorted(found, key=lambda x: (-len(x[0]), x[1])) for host, found in out.items()}


def expression(rule: str) -> str:
    """A rule's regular expression over lower-cased URLs."""
    begin, end, body = "", "", rule
    if body.startswith("||"):
        begin, body = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        begin, body = "^", body[1:]
    if body.endswith("|"):
        end, body = "$", body[:-1]
    special = {"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}
    return begin + "".join(special.get(c) or re.escape(c) for c in body) + end


def literal_tokens(rule: str) -> list[str]:
    """The tokens that every match of a rule has as whole tokens."""
    found = []
    for m in _TOKENS.finditer(rule):
        left, right = rule[: m.start()], rule[m.end() :]
        if left and right and not left.endswith("*") and not right.startswith("*"):
            found.append(m[0])
    return found


def pattern_index(patterns) -> dict[str, list[str]]:
    """The regular expressions under the rarest literal token of each rule; under an empty one, those without."""
    tokens = {p: literal_tokens(p) for p in dict.fromkeys(patterns)}
    count = Counter(t for some in tokens.values() for t in set(some))
    out = defaultdict(list)
    for p, some in tokens.items():
        out[min(some, key=lambda t: (count[t], t), default="")].append(expression(p))
    return dict(out)


_compiled: dict[str, re.Pattern] = {}


def blocked(url: str, index: dict[str, list[str]], told: Counter | None = None) -> bool:
    """Whether any rule of the index matches a lower-cased URL; ``told`` counts the expressions that were run."""
    for token in dict.fromkeys(["", *_TOKENS.findall(url)]):
        for pattern in index.get(token, ()):
            if (run := _compiled.get(pattern)) is None:
                run = _compiled[pattern] = re.compile(pattern, re.DOTALL)
            if told is not None:
                told["run"] += 1
            if run.search(url):
                return True
    return False


def _judge(urls, sent):
    rules, patterns = sent.value
    hosts, paths, found, verdicts = [], [], [], []
    for url in urls:
        host, path = parts(url)
        best, suffix = None, host
        while True:
            for start, rule, verdict in rules.get(suffix, ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            _, dot, suffix = suffix.partition(".")
            if not dot:
                break
        if best is None:
            verdict = "block" if (host or path) and blocked(url.lower(), patterns) else "allow"
        hosts.append(host)
        paths.append(path)
        found.append(best and best[0])
        verdicts.append(best[1] if best else verdict)
    return [hosts, paths, found, verdicts]


def judge(df: DataFrame, url: str = "url", rules=RULES, patterns=PATTERNS) -> DataFrame:
    """``df`` with host, path, rule and verdict. The rules are a list on the driver; their indexes are broadcast."""
    outputs = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]
    sent = df.sparkSession.sparkContext.broadcast((rule_index(rules), pattern_index(patterns)))
    return with_python(df, partial(_judge, sent=sent), [url], outputs)


def op6_urls(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = rf"""
WITH u AS (
  SELECT page_id, lower(coalesce(url, '')) AS low,
         translate(regexp_extract(coalesce(url, ''), '^[^:]*(?::[^/][^:]*|:/[^/][^:]*)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(rule, rhost, rpath, v) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
  ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), fit AS (
  SELECT page_id, u.host, u.path, low, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v
  FROM u LEFT JOIN r ON ('.' || u.host) LIKE ('%.' || rhost) AND starts_with(u.path, rpath)
  GROUP BY page_id, u.host, u.path, low
)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN regexp_matches(low, '[./-]({'|'.join(JUNK)}|({'|'.join(FIRST)})[-_]?({'|'.join(SECOND)}))[./-]|free-money|/track/pixel') THEN 'block' ELSE 'allow' END) AS verdict
FROM fit
"""
