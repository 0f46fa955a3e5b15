"""Language identification by Bayesian evidence fusion.

log P(language | row) = likelihood of the text's letter trigrams
                      + log P(declared language | language)
                      + log prior of the row's host,
where a host's prior is its share of each language, smoothed with the share of its address
suffix, which is smoothed with the share over all rows.  The shares are sums of text-only
posteriors, so they are grouped aggregations over all rows; each row is left out of its
own prior.  One more class, UNKNOWN, has evenly spread trigrams; it takes random letters
and languages outside the list.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.llm import common
from wattledger.session import materialize

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
#: hashed trigrams: the model has (languages + 1) * BUCKETS numbers whatever the data
BUCKETS = 1 << 16
#: trigrams that UNKNOWN spreads its weight over
UNKNOWN_SPREAD = 1 << 14
#: trigrams overlap, so their log-likelihoods count by this share
TEMPER = 1 / 3
#: P(declared = language), and the prior share of UNKNOWN
DECLARED_RIGHT, UNKNOWN_PRIOR = 0.8, 0.001
#: rows that the level above is worth in a host's or suffix's share
STRENGTH = 20.0
#: a row below this posterior is rejected
LEAST_CONFIDENCE = 0.5

#: bytes of text in one numpy pass; trigrams take some forty times as much for a moment
PASS_BYTES = 1 << 20

_LETTER = np.zeros(256, np.uint8)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[128:] = np.arange(128, 256)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every letter trigram, number of trigrams per text).

    Bytes that are no letters count as one gap; a trigram has its letter in the middle.
    """
    raw = np.frombuffer(b"\0".join([b"", *texts, b""]), np.uint8)
    letters = _LETTER[raw].astype(np.uint32)
    full = np.flatnonzero(letters[1:-1]) if len(letters) > 2 else np.empty(0, np.int64)
    code = (letters[full] << np.uint32(16)) | (letters[full + 1] << np.uint32(8)) | letters[full + 2]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(full, ends - 1, "left") if len(texts) else np.empty(0, np.int64)
    return bucket, np.diff(upto, prepend=0)


def _counts(languages: Sequence[str]):
    index = {name: i for i, name in enumerate(languages)}

    def count(batches):
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in common.passes(batches, "text", PASS_BYTES):
            bucket, sizes = trigrams(common.texts(batch, "text"))
            kind = np.array([index.get(d, -1) for d in batch.column("declared").to_pylist()], np.int64)
            kind = np.repeat(kind, sizes)
            total += np.bincount(kind[kind >= 0] * BUCKETS + bucket[kind >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    return count


def train(rows: DataFrame, languages: Sequence[str] = LANGUAGES) -> np.ndarray:
    """Log-likelihood of every trigram bucket under every language and UNKNOWN, from rows (text, declared).

    All rows with a declared language of the list are counted; the sum has at most
    languages * BUCKETS rows.
    """
    cells = rows.select("text", "declared").mapInArrow(_counts(languages), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(len(languages) * BUCKETS)
    n[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float64)
    n = n.reshape(len(languages), BUCKETS) + 0.1
    known = np.log(n / n.sum(1, keepdims=True))
    return np.vstack([known, np.full((1, BUCKETS), -math.log(UNKNOWN_SPREAD))]).astype(np.float32)


def _scores(model: np.ndarray):
    def score(batches):
        for batch in common.passes(batches, "text", PASS_BYTES):
            bucket, sizes = trigrams(common.texts(batch, "text"))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            logs = np.zeros((len(sizes), len(model)))
            for i, row in enumerate(model):
                upto = np.concatenate([[0.0], np.cumsum(row[bucket], dtype=np.float64)])
                logs[:, i] = (upto[starts[1:]] - upto[starts[:-1]]) * TEMPER
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("declared"), batch.column("host"), batch.column("suffix"), pa.array(sizes), pa.array(list(logs), pa.list_(pa.float64()))],
                ["id", "declared", "host", "suffix", "n_trigrams", "logs"],
            )

    return score


def _posterior(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs)
    weights = [F.exp(x - top) for x in logs]
    total = sum(weights[1:], weights[0])
    return [w / total for w in weights]


def identify(rows: DataFrame, languages: Sequence[str] = LANGUAGES, model: np.ndarray | None = None) -> DataFrame:
    """One row per row of ``rows`` (id, text, declared, host, suffix): id, language, confidence, accepted, declared, host.

    ``declared`` is the language that the markup or a label names, any other value or null
    where there is none; null hosts and suffixes are one group each.  Rows whose text has
    no letter, or whose best class is UNKNOWN or below LEAST_CONFIDENCE, are not accepted
    (a text without letters is UNKNOWN with confidence 1).  Ties go to the first language of
    the list.  Rows may repeat, ids may be null; an empty table gives an empty result.
    """
    names = [*languages, UNKNOWN]
    own = rows.select(
        F.col("id"),
        F.col("text").cast("string").alias("text"),
        F.lower("declared").alias("declared"),
        F.coalesce(F.lower("host"), F.lit("")).alias("host"),
        F.coalesce(F.lower("suffix"), F.lit("")).alias("suffix"),
    )
    model = train(own, languages) if model is None else model
    kind = own.schema["id"].dataType.simpleString()
    scored = materialize(own.mapInArrow(_scores(model), f"id {kind}, declared string, host string, suffix string, n_trigrams long, logs array<double>"), "scored")
    k = len(names)
    text_only = _posterior([F.get("logs", F.lit(i)) for i in range(k)])
    weighed = scored.select("*", *[p.alias(f"p{i}") for i, p in enumerate(text_only)])
    counted = weighed.where(F.col("n_trigrams") > 0)
    hosts = counted.groupBy("suffix", "host").agg(*[F.sum(f"p{i}").alias(f"h{i}") for i in range(k)])
    hosts = materialize(hosts, "hosts")
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"h{i}").alias(f"s{i}") for i in range(k)])
    whole = hosts.agg(*[F.sum(f"h{i}").alias(f"g{i}") for i in range(k)]).first()
    total = sum(whole[f"g{i}"] or 0.0 for i in range(k))
    base = [UNKNOWN_PRIOR if i == k - 1 else ((whole[f"g{i}"] or 0.0) + 1) / (total + k) for i in range(k)]
    known = hosts.join(suffixes, "suffix")
    merged = weighed.join(known, ["suffix", "host"], "left")

    def share(i: int) -> Column:
        """The host's share of a language without this row, smoothed level by level."""
        own_p = F.when(F.col("n_trigrams") > 0, F.col(f"p{i}")).otherwise(0.0)
        left = lambda c: F.greatest(F.coalesce(F.col(f"{c}{i}"), F.lit(0.0)) - own_p, F.lit(0.0))
        count = lambda c: F.greatest(F.coalesce(sum((F.col(f"{c}{j}") for j in range(1, k)), F.col(f"{c}0")), F.lit(0.0)) - 1, F.lit(0.0))
        suffix = (left("s") + STRENGTH * base[i]) / (count("s") + STRENGTH)
        return (left("h") + STRENGTH * suffix) / (count("h") + STRENGTH)

    def declared(i: int) -> Column:
        wrong = math.log((1 - DECLARED_RIGHT) / k)
        if names[i] == UNKNOWN:
            return F.when(F.col("declared").isNotNull(), math.log(1 / (k + 1))).otherwise(0.0)
        return F.when(F.col("declared") == names[i], math.log(DECLARED_RIGHT)).when(F.col("declared").isNotNull(), wrong).otherwise(0.0)

    fused = merged.select("id", "declared", "host", "n_trigrams", *[(F.get("logs", F.lit(i)) + F.log(share(i)) + declared(i)).alias(f"f{i}") for i in range(k)])
    posterior = fused.select("id", "declared", "host", "n_trigrams", *[p.alias(f"q{i}") for i, p in enumerate(_posterior([F.col(f"f{i}") for i in range(k)]))])
    best = F.greatest(*[F.col(f"q{i}") for i in range(k)])
    silent = F.col("n_trigrams") == 0
    language = F.when(silent, UNKNOWN)
    for i, name in enumerate(names):
        language = language.when(F.col(f"q{i}") == best, name)
    judged = posterior.select("id", language.alias("language"), F.when(silent, 1.0).otherwise(best).alias("confidence"), "declared", "host")
    return judged.select("id", "language", "confidence", ((F.col("language") != UNKNOWN) & (F.col("confidence") >= LEAST_CONFIDENCE)).alias("accepted"), "declared", "host")


def of_documents(docs: DataFrame, id: Column | None = None) -> DataFrame:
    """Rows for ``identify``: the declared language is the column lang, the host the column source."""
    return docs.select((F.col("doc_id").cast("long") if id is None else id).alias("id"), "text", F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Rows for ``identify``: markup language, host and address suffix of web pages, and their visible text."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&[A-Za-z0-9#]+;", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("id"),
        visible.alias("text"),
        F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit("")).alias("declared"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"),
    )


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows, all columns as they came.

    A verdict holds for what it was drawn from (text, lang and source), so rows that share
    a doc_id are judged each by its own, and rows without a doc_id are judged too.
    """
    evidence = F.md5(F.to_json(F.struct("text", "lang", "source")).cast("binary"))
    verdicts = materialize(identify(of_documents(docs, evidence)), "language").where(~F.col("accepted")).select(F.col("id").alias("__evidence"))
    return common.without_members(docs.withColumn("__evidence", evidence), verdicts, "__evidence").drop("__evidence")
