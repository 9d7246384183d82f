"""Language identification by fusing evidence in the log domain (naive Bayes over sources of evidence).

posterior(language) ~ prior(host) * P(text | language) * P(declared | language) * P(suffix | language)

* Text: byte trigrams of the lower-cased text, hashed to BUCKETS, with smoothed multinomials for each
  language that are trained on labelled rows. Trigrams of a text are not independent, so the log
  likelihood is tempered: its mean for a trigram times the smaller of their number and TEMPER.
* Declared markup language and address suffix agree with the language with some reliability, and else
  name any other one evenly. How reliable either is, is measured: it is the mean text posterior of the
  language that is said, over all rows that say a known one, with PRIOR_ROWS rows of the prior guess. So a
  label that texts do not bear out says little, and none decides its own row. Unknown or missing ones say
  nothing.
* Host priors: tempered evidence makes soft counts by host, by grouped aggregation over all rows; a
  host's prior is its counts smoothed by its domain's, those by its suffix's, those by the whole table's,
  those by an even prior. One row for each host is joined back; the table is broadcast only if small.

Each text is scored once, in batches; the scores are written with the rows, and what follows reads them.
A row is kept if it has letters enough to say anything, its best language beats the even guess
clearly, and its text is not less likely under that language than text of even bytes.

Defined results: null or empty text, or text without letters, has no language and is not kept; a null
host has the whole table's prior, and a host without a dot has no domain; of languages with equal
posteriors the first by name counts; labels and declared languages count by their first letters a-z in
small letters, so en-US is en; of more than MOST_LABELS labels those with most rows are trained; very long
texts are scored whole; rows that share a doc_id are judged each on their own; an empty table gives no
rows; with no labelled rows at all nothing can be told and nothing is kept; columns other than those named
are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import hashing as H
from textloom.llm.common import as_bytes, bounded_batches, discard, materialize, trim

BUCKETS = 1 << 15
#: The classifier is fitted on this many distinct labelled texts of each language at most.
TRAIN_ROWS = 500
TEMPER = 60.0
#: Prior guesses, and the rows that they count as.
DECLARED_RELIABLE = 0.8
SUFFIX_RELIABLE = 0.6
PRIOR_ROWS = 20.0
MOST_RELIABLE = 0.95
HOST_STRENGTH = 20.0
LEAST_POSTERIOR = 0.5
BROADCAST_ROWS = 200_000
#: So many languages are trained at most.
MOST_LABELS = 200

#: Address suffixes that hint at a language (fixed values: country codes).
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "nl": "nl", "pl": "pl"}

_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of letters and single gaps, and for each the index of its text; all that is not
    a letter is a gap, and a text has one at both ends."""
    hashed, owner = [], []
    for lo, hi in H.blocks(texts):
        raw = np.frombuffer(b"\n" + b"\n".join(texts[lo:hi]) + b"\n", np.uint8)
        ends = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
        letter = _LETTER[raw]
        gap = letter == 0
        at = np.flatnonzero(~gap | np.append(True, ~gap[:-1]))  # the first of each run of gaps
        if len(at) < 3:
            continue
        a, text = letter[at].astype(np.int64), np.searchsorted(ends, at, side="right") - 1
        # a gap between the last letter of a text and the first of a later one is no trigram of either
        inside = np.flatnonzero((a[1:-1] != 0) | (text[:-2] == text[2:]))
        hashed.append(((a[inside] * 65599 + a[inside + 1] * 257 + a[inside + 2]) * 2654435761 >> 7) & (BUCKETS - 1))
        owner.append(np.where(a[inside + 1] != 0, text[inside + 1], text[inside]) + lo)
    if not hashed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashed), np.concatenate(owner)


@dataclass
class Model:
    """languages, log probabilities (languages x BUCKETS) and the log probability of an even trigram."""

    languages: list[str]
    table: np.ndarray
    even: float

    def means(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log likelihoods of a trigram (texts x languages), and the numbers of trigrams."""
        means, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for lo, hi in H.blocks(texts):
            g, owner = trigrams(texts[lo:hi])
            sizes[lo:hi] = n = np.bincount(owner, minlength=hi - lo)
            for k, row in enumerate(self.table):
                means[lo:hi, k] = np.bincount(owner, row[g], minlength=hi - lo) / np.maximum(n, 1)
        return means, sizes


def normal(language: Column) -> Column:
    """The first letters a-z of a label or declared language, in small letters; null without any."""
    return F.nullif(F.regexp_extract(F.lower(language.cast("string")), "^[a-z]+", 0), F.lit(""))


def train(rows: DataFrame, text: str = "text", label: str = "lang", per_language: int = TRAIN_ROWS) -> Model:
    """Fit the text model on labelled rows: of each language the per_language distinct texts with the least
    hashes, or all if it has fewer, so that every language with a row is in the model and copies count
    once. The counts are made where the rows are; one row for each language comes to the driver."""
    bounded_batches(rows)
    labelled = rows.select(normal(F.col(label)).alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(text), F.lit(7)).alias("hash")).where("label IS NOT NULL AND text IS NOT NULL")
    common = labelled.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MOST_LABELS).select("label")
    labelled = labelled.join(F.broadcast(common), "label")

    def least(batches):
        kept: dict[str, np.ndarray] = {}
        for b in batches:
            labels = b.column("label").dictionary_encode()
            at, h = labels.indices.to_numpy(), b.column("hash").to_numpy()
            for i, k in enumerate(labels.dictionary.to_pylist()):
                kept[k] = H.distinct(np.concatenate([kept.get(k, h[:0]), h[at == i]]))[:per_language]
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.list_(pa.int64()))], ["label", "hashes"])

    def limit(t: pa.Table) -> pa.Table:
        hashes = H.distinct(t["hashes"].combine_chunks().flatten().to_numpy())[:per_language]
        return pa.table({"label": t["label"][:1], "most": pa.array(hashes[-1:], pa.int64())})

    limits = labelled.select("label", "hash").mapInArrow(least, "label string, hashes array<long>").groupBy("label").applyInArrow(limit, "label string, most long")
    picked = labelled.join(F.broadcast(limits), "label").where("hash <= most").select("label", "text", "hash").dropDuplicates(["label", "hash"])

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, raw in zip(b.column("label").to_pylist(), as_bytes(b.column("text"))):
                total.setdefault(lang, np.zeros(BUCKETS))
                total[lang] += np.bincount(trigrams([raw])[0], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["label", "counts"])

    def merge(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in t["counts"].to_pylist())
        return pa.table({"label": t["label"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    got = picked.mapInArrow(count, "label string, counts binary").groupBy("label").applyInArrow(merge, "label string, counts binary").collect()
    got = sorted((r.label, np.frombuffer(bytes(r.counts))) for r in got if r.counts is not None)
    table = np.array([np.log((c + 0.1) / (c.sum() + 0.1 * BUCKETS)) for _, c in got]).reshape(len(got), BUCKETS)
    return Model([k for k, _ in got], table, -math.log(BUCKETS))


def _agreement(said: Column, languages: list[str], reliable: float) -> Column:
    """log P(said | language) for each language, all 0 where nothing known is said."""
    other = math.log((1 - reliable) / max(1, len(languages) - 1))
    known = said.isin(languages)
    return F.array(*(F.when(known, F.when(said == k, math.log(reliable)).otherwise(other)).otherwise(0.0) for k in languages))


def _reliability(scored: DataFrame, said: str, languages: list[str], guess: float) -> tuple[Column, Column]:
    """Sums over rows that say a known language: its text posterior, and 1."""
    p = _softmax(F.col("evidence"))
    known = F.col(said).isin(languages) & (F.col("n") > 0)
    borne = F.element_at(p, F.array_position(F.array(*(F.lit(k) for k in languages)), F.col(said)).cast("int"))
    return F.sum(F.when(known, borne)), F.count(F.when(known, 1))


def _softmax(logs: Column) -> Column:
    most = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - most))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda x: x / total)


def identify(rows: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, carry: tuple = ()) -> DataFrame:
    """Returns id_column, language (null if none can be told), posterior, text_margin (mean log
    likelihood of a trigram above even bytes), n_trigrams, kept; and the columns of `carry`, whole."""
    langs = model.languages
    n = len(langs)
    bounded_batches(rows)
    null = F.lit(None).cast("string")
    own = [F.col(f"row.x{i}").alias(c) for i, c in enumerate((id_column, *carry))]
    row = F.struct(*(F.col(c).alias(f"x{i}") for i, c in enumerate((id_column, *carry))))
    if not n:
        return rows.select(row.alias("row")).select(*own, null.alias("language"), F.lit(0.0).alias("posterior"), F.lit(0.0).alias("text_margin"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("kept"))

    @F.arrow_udf(T.StructType([T.StructField("means", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())]))
    def likelihood(texts: pa.Array) -> pa.Array:
        means, size = model.means(as_bytes(texts))
        lists = pa.ListArray.from_arrays(np.arange(len(size) + 1) * n, means.reshape(-1))
        trim()
        return pa.StructArray.from_arrays([lists, pa.array(size, pa.int64())], ["means", "n"])

    hint = F.create_map(*(F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv))
    said = rows.select(row.alias("row"), likelihood(F.col(text)).alias("seen"), normal(declared if declared is not None else null).alias("declared"), (host if host is not None else null).alias("host"), F.try_element_at(hint, F.lower(suffix if suffix is not None else null)).alias("suffix"))
    scored = materialize(said.select("row", "declared", "host", "suffix", F.col("seen.means").alias("means"), F.col("seen.n").alias("n")), "scored")
    scored = scored.withColumn("evidence", F.transform("means", lambda m: m * F.least(F.col("n").cast("double"), F.lit(TEMPER))))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    sources = (("declared", DECLARED_RELIABLE), ("suffix", SUFFIX_RELIABLE))
    sums = scored.agg(*(x.alias(f"{k}{i}") for k, guess in sources for i, x in enumerate(_reliability(scored, k, langs, guess)))).first()
    logs = F.col("evidence")
    for k, guess in sources:
        rate = ((sums[f"{k}0"] or 0.0) + guess * PRIOR_ROWS) / (sums[f"{k}1"] + PRIOR_ROWS)
        logs = add(logs, _agreement(F.col(k), langs, min(MOST_RELIABLE, max(1 / n, rate))))
    scored = scored.withColumn("logs", logs)
    # soft counts by host, from all rows with evidence
    soft = scored.where("n > 0").select("host", _softmax(F.col("logs")).alias("p"))
    by_host = soft.groupBy("host").agg(*(F.sum(F.element_at("p", i + 1)).alias(f"c{i}") for i in range(n)))
    label = lambda k: F.regexp_extract(F.coalesce("host", F.lit("")), k, 1)
    by_host = materialize(by_host.withColumn("domain", label(r"([^.]+\.[^.]+)$")).withColumn("top", label(r"\.([^.]+)$")), "hosts")
    total = by_host.agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(n))).first()
    whole = np.array([float(total[f"c{i}"] or 0) for i in range(n)]) + 1.0
    whole /= whole.sum()

    def smooth(counts: str, prior: list) -> list:
        """A level's shares of its soft counts, smoothed by those of the level above."""
        own_counts = [F.col(f"{counts}{i}") for i in range(n)]
        return [(c + HOST_STRENGTH * p) / (sum(own_counts, F.lit(0.0)) + HOST_STRENGTH) for c, p in zip(own_counts, prior)]

    def level(key: str, mark: str) -> DataFrame:
        return by_host.where(F.col(key) != "").groupBy(key).agg(*(F.sum(f"c{i}").alias(f"{mark}{i}") for i in range(n)))

    even = [F.lit(float(w)) for w in whole]
    tops = level("top", "t").select("top", *(x.alias(f"pt{i}") for i, x in enumerate(smooth("t", even))))
    domains = level("domain", "d").withColumn("top", F.regexp_extract("domain", r"\.([^.]+)$", 1)).join(tops, "top")
    domains = domains.select("domain", *(x.alias(f"pd{i}") for i, x in enumerate(smooth("d", [F.col(f"pt{i}") for i in range(n)]))))
    hosts = by_host.where("host IS NOT NULL").join(domains, "domain", "left")
    above = [F.coalesce(F.col(f"pd{i}"), w) for i, w in enumerate(even)]
    hosts = materialize(hosts.select("host", F.array(*(F.log(x) for x in smooth("c", above))).alias("prior")), "priors")
    discard(by_host)
    if hosts.count() <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    p = _softmax(add(F.col("logs"), F.coalesce("prior", F.array(*(F.log(w) for w in even)))))
    out = scored.join(hosts, "host", "left").withColumn("p", p).withColumn("posterior", F.array_max("p"))
    at = F.array_position("p", F.col("posterior")).cast("int")
    out = out.withColumn("language", F.when(F.col("n") > 0, F.element_at(F.array(*(F.lit(k) for k in langs)), at)))
    out = out.withColumn("text_margin", F.element_at("means", at) - model.even)
    kept = (F.col("n") > 0) & (F.col("posterior") >= LEAST_POSTERIOR) & ((F.col("text_margin") > 0) | (F.col("n") < 20))
    return out.select(*own, "language", "posterior", "text_margin", F.col("n").alias("n_trigrams"), kept.alias("kept"))


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host and last label of a url's host; null without one."""
    host = F.lower(F.regexp_extract(url, r"://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    return host, F.regexp_extract(host, r"([^.]+)$", 1)


def declared_language(html: Column) -> Column:
    """The lang attribute of the html element."""
    return F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]+)", 1)


def page_text(html: Column) -> Column:
    """Text of markup, well enough to tell its language: scripts, styles, tags and references go."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>|&#?\w+;", " ")
