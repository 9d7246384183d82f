"""URL filter: allow and block rules by host and path, and a classifier for urls that no rule fits.

Host, path and the longest rule that fits are plain column expressions. The classifier is a logistic
regression on hashed character n-grams of host and path, each in its own part of the feature space. It is
fitted on the driver from a small labelled url table (training_table() below, or any list of
(url, blocked) of at most MOST_TRAINING rows) by full-batch gradient steps from zero with a fixed number of
steps, so that it is the same on every run. Labels count as often as they are in the table, where most
hosts are wanted, as on the web; so a url of n-grams that say nothing is allowed. The weights, 8 bytes for
each of BUCKETS buckets, go to the tasks; urls are judged where they are, in batches, with no shuffle.

Defined results: a null url, or one without '://', has empty host and path, fits no rule and is judged by
the classifier on the n-grams of nothing, which the table has as wanted; an empty host fits no rule;
ports and user names are part of the host as written; very long urls are judged whole; repeated rows return
a row each; of rules of equal length that fit, the host's longest wins; a score of exactly THRESHOLD is
blocked; an empty table gives no rows; columns other than page_id and url are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import hashing as H

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
STEPS = 300
RATE = 2.0
PENALTY = 1e-3
MOST_TRAINING = 20_000
THRESHOLD = 0.5

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: The labelled url table is made of these: words of hosts that a corpus wants out, and of ordinary ones.
_UNWANTED = "casino casinos jackpot slots poker bets betting bet365x gambling roulette pills pharmacy viagra cialis meds-online linkfarm seo-spam spamlinks adtrack adserver clickads popads bannerads tracker-ads doubleclicks free-money win-money quick-loans payday-loans adult-cams adult-video xxx porn porntube sex-chat escorts hot-dating torrents warez crack-keys keygen replica-watches cheap-followers".split()
_WITH_UNWANTED = "best online free win royal shop cheap buy vip live club zone hub top".split()
_WANTED = "news library museum university docs wiki blog forum science weather history city council school recipe travel garden music cinema book journal health research archive gazette kitchen sports football clinic theatre standard nation thread mother farmer winter address freedom home spanish lovely station northern thinking search mail maps code git data open source project python java stack over flow linux space earth world post times guardian herald tribune daily weekly review press bank insurance energy water rail air port hotel art design photo film game radio tech computer phone mobile cloud software network academy college institute society foundation group company studio press agency ministry court parliament government police fire army church charity union market store food farm fish wood stone steel paper glass river mountain island forest sea wind solar car bike road bridge house family children people law tax job work life body mind sun moon star".split()
_SYLLABLES = "an be ca der el fo gra hin in jo ka lo mi na or pe qua ri sta ti un ver wi xa yo zu".split()
_TOPS = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "co.uk", "io", "int", "info", "example.com", "example.net", "example.org")
_UNWANTED_PATHS = ("/casino/bonus", "/win/jackpot", "/track/click?id=1", "/buy/cheap-pills", "/free-bets/today", "/ads/banner")
_PATHS = ("", "/", "/about", "/index.html", "/en/20", "/fr/article-3.html", "/de/410", "/es/7/", "/2021/05/report.html", "/2024/x.html", "/news/2023/12/01/story", "/wiki/Main_Page", "/contact", "/products/item-12", "/search?q=word", "/docs/guide/intro.html", "/blog/a-day-out", "/en/12345#top", "/images/logo.png", "/user/name")


def training_table() -> list[tuple[str, int]]:
    """The small labelled url table: (url, 1 if unwanted). Paths and domains go through the same values
    under either label, so that hosts, and the paths that only unwanted pages have, decide."""
    rows = [("", 0)]
    turn = 0

    def add(host: str, paths: tuple, label: int, n: int) -> None:
        nonlocal turn
        for _ in range(n):
            turn += 1
            prefix = ("", "www.", "www.", "m.", "blog.")[turn % 5]
            rows.append((f"https://{prefix}{host}.{_TOPS[turn * 7 % len(_TOPS)]}{paths[turn * 3 % len(paths)]}", label))

    for i, w in enumerate(_WANTED):
        other = _WANTED[(i * 37 + 11) % len(_WANTED)]
        add(w, _PATHS, 0, 3)
        add(w + other, _PATHS, 0, 2)
        add(f"{other}-{w}", _PATHS, 0, 2)
    for i in range(600):  # names that are no words
        add("".join(_SYLLABLES[(i * k + k * k + i // 9) % len(_SYLLABLES)] for k in range(1, 2 + i % 4)), _PATHS, 0, 1)
        add("".join("abcdefghijklmnopqrstuvwxyz"[(i * 7 + k * k * 5 + i // 3 * k) % 26] for k in range(2 + i % 4)), _PATHS, 0, 1)
    for i, w in enumerate(_UNWANTED):
        add(w, _PATHS, 1, 3)
        for k in range(4):
            other = _WITH_UNWANTED[(i + k * 5) % len(_WITH_UNWANTED)]
            add(f"{other}-{w}" if k % 2 else w + other, _PATHS, 1, 1)
            add(f"{w}-{other}" if k % 2 else other + w, _PATHS, 1, 1)
    for i, w in enumerate(_WANTED):
        add(f"{w}{_WANTED[(i * 11 + 5) % len(_WANTED)]}", _UNWANTED_PATHS, 1, 1) if i % 2 else None
    return rows


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without '://'."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text and verdict; null if none does."""
    text = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p) & (host != "")
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def split_url(url: str | None) -> tuple[str, str]:
    """url_parts for one url of the labelled table."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(str.maketrans(_UPPER, _LOWER)), slash + path


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the character n-grams of host and path: (row, bucket), by row."""
    rows, buckets = [], []
    for kind, texts in enumerate((hosts, paths)):
        marked = [f"^{t}$" for t in texts]
        size = np.array([len(t) for t in marked], np.int64)
        code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(marked)), size)
        for n in GRAMS:
            if len(code) >= n:
                inside = np.flatnonzero(owner[: len(code) - n + 1] == owner[n - 1 :])
                rows.append(owner[inside])
                buckets.append(H.windows(code + np.uint64(kind << 32), n)[inside] % np.uint64(BUCKETS))
    both = H.distinct(np.concatenate(rows).astype(np.uint64) * np.uint64(BUCKETS) + np.concatenate(buckets)) if rows else np.zeros(0, np.uint64)
    return (both // np.uint64(BUCKETS)).astype(np.int64), (both % np.uint64(BUCKETS)).astype(np.int64)


class Classifier:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability that each url is unwanted."""
        row, at = features(hosts, paths)
        n = np.bincount(row, minlength=len(hosts))
        z = np.bincount(row, self.weights[at], minlength=len(hosts)) / np.sqrt(np.maximum(n, 1)) + self.intercept
        return 1 / (1 + np.exp(-z))

    def score(self, host: str, path: str) -> float:
        return float(self.scores([host], [path])[0])


def fit(rows: Iterable[tuple[str, int]]) -> Classifier:
    """Logistic regression with an L2 penalty; each url's features have a vector of length 1."""
    rows = list(rows)
    if len(rows) > MOST_TRAINING:
        raise ValueError(f"more than {MOST_TRAINING} labelled urls")
    parts = [split_url(u) for u, _ in rows]
    y = np.array([float(b) for _, b in rows])
    row, at = features([h for h, _ in parts], [p for _, p in parts])
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))[row]
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(STEPS):
        z = np.bincount(row, w[at] * value, minlength=len(y)) + b
        g = (1 / (1 + np.exp(-z)) - y) / len(y)
        w -= RATE * 10 * (np.bincount(at, g[row] * value, minlength=BUCKETS) + PENALTY / len(y) * w)
        b -= RATE * g.sum()
    return Classifier(w, b)


SCHEMA = "page_id long, host string, path string, rule string, verdict string, score double"


def _judge(model: Classifier):
    def judged(batches):
        for b in batches:
            verdict = b.column("verdict").to_pylist()
            open_ = [i for i, v in enumerate(verdict) if v is None]
            hosts, paths = (b.column(c).to_pylist() for c in ("host", "path"))
            score = [None] * len(verdict)
            for i, p in zip(open_, model.scores([hosts[i] for i in open_], [paths[i] for i in open_]).tolist()):
                score[i], verdict[i] = p, "block" if p >= THRESHOLD else "allow"
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(score, pa.float64())], [f.split()[0] for f in SCHEMA.split(", ")])

    return judged


def filter_urls(pages: DataFrame, model: Classifier | None = None, rules=RULES) -> DataFrame:
    """A row for each page: page_id, host, path, rule (host and path of the longest that fits, or null),
    verdict (the rule's, else the classifier's) and score (null where a rule decides)."""
    host, path = url_parts(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict")).mapInArrow(_judge(model or fit(training_table())), SCHEMA)
