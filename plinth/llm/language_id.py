"""Language ID: Bayesian fusion of what speaks for a language.

For each document, the logarithms of these are summed over the languages that were learned:

* the likelihood of its text (of a page: without tags, scripts, styles and comments) under byte trigrams, tempered: n
  trigrams count as n ** ``TEMPER``, as neighbouring trigrams don't speak independently;
* the declared language of its markup (``<html lang=...>``), if there is one;
* the language that its address suffix (or first path part) suggests, if there is one;
* the prior of its host: how its other documents' texts look, counted by grouped aggregation and
  smoothed towards the host's domain, which is smoothed towards all documents. The document itself is
  taken out of all three counts.

The trigram model is fitted on labelled rows, about ``SAMPLE`` of them, in equal parts for each
label and chosen by a hash of id and text (a label of fewer rows gives all of them); scoring and priors
cover every row and every whole text. Every label is learned. A document is rejected if
its text has no letters, or if the best language's posterior stays under ``LEAST``.

Scale: texts are only mapped. What is joined are a few numbers for each document with one row
for each host; hosts are aggregated with partial sums, so a hot host meets in no task. The
model has ``BUCKETS`` x labels numbers; labels are meant to be names of languages, some hundreds at most.

Defined cases: a null text, or one without letters, is rejected with language null and
confidence 0; a null host has the prior of all documents. Where two languages are equally likely, the
first by name is said. Without labelled rows nothing is
learned and every document is rejected. Repeated rows each give a row, and count as other documents of
their host. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import staged, text_slices, trimmed
from plinth.llm.url_lists import host_of

#: Labelled rows for fitting, about.
SAMPLE = 4_000
BUCKETS = 1 << 14
TEMPER = 0.75
LEAST = 0.5
#: Documents that a host's, and a domain's, parent counts for.
STRENGTH = 10.0
#: How often the markup, and the address, name a page's language rightly.
MARKUP_RIGHT, ADDRESS_RIGHT = 0.9, 0.8

#: What tells a page from a plain text, and what of it isn't text: scripts, styles and comments, to their end or the page's.
PAGE = r"(?i)<(?:html|!doctype\s+html)[\s>]"
UNSEEN = r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)"

#: Languages that address suffixes suggest.
SUFFIXES = {
    "ar": "es", "at": "de", "au": "en", "be": "nl", "bg": "bg", "bo": "es", "br": "pt", "by": "be", "ca": "en", "ch": "de", "cl": "es", "cn": "zh", "co": "es", "cr": "es", "cz": "cs", "de": "de", "dk": "da",
    "do": "es", "ec": "es", "ee": "et", "eg": "ar", "es": "es", "fi": "fi", "fr": "fr", "gr": "el", "hr": "hr", "hu": "hu", "id": "id", "ie": "en", "il": "he", "ir": "fa", "is": "is", "it": "it", "jp": "ja",
    "kr": "ko", "li": "de", "lt": "lt", "lv": "lv", "ma": "ar", "mx": "es", "my": "ms", "nl": "nl", "no": "no", "nz": "en", "pe": "es", "pl": "pl", "pt": "pt", "py": "es", "ro": "ro", "rs": "sr", "ru": "ru",
    "sa": "ar", "se": "sv", "si": "sl", "sk": "sk", "sn": "fr", "th": "th", "tn": "ar", "tr": "tr", "tw": "zh", "ua": "uk", "uk": "en", "us": "en", "uy": "es", "ve": "es", "vn": "vi", "za": "en",
}


@dataclass
class Model:
    languages: list[str]
    #: log probability of each bucket (rows) in each language (columns).
    weights: np.ndarray


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of byte trigrams: letters in lower case, everything else a blank, and with a letter in the middle."""
    low = _LOWER[data]
    letter = _LETTER[low]
    low = np.where(letter, low, 0x20).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = letter[1:-1] & (text[:-2] == text[2:])
    code = (low[:-2] * np.uint32(0x01000193) ^ low[1:-1]) * np.uint32(0x01000193) ^ low[2:]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(18)
    return text[:-2][ok], code[ok].astype(np.int64)


@trimmed
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = np.array(batch.column("label").to_pylist(), dtype=object)
        for row, end, data, offsets in text_slices(batch.column("text")):
            text, bucket = trigrams(data, offsets)
            for label in set(labels[row:end]):
                n = np.bincount(bucket[labels[row + text] == label], minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["label", "bucket", "n"])


def fit(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> Model:
    """Trigram probabilities from about ``sample`` labelled rows, as many of each label where it has them."""
    given = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col(label).alias("label"))
    sizes = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    languages = sorted(sizes)
    counts = np.full((BUCKETS, len(languages)), 0.5)
    if languages:
        # the lowest hashes of a label, as many as make its part; a label's rows are all taken if they are few
        part = {x: sample / len(languages) / n for x, n in sizes.items()}
        limits = F.create_map(*[F.lit(v) for x in languages for v in (x, 2**63 - 1 if part[x] >= 1 else int((2 * part[x] - 1) * 2**63))])
        chosen = given.where(F.xxhash64("doc_id", "text") <= F.element_at(limits, F.col("label")))
        rows = chosen.select("label", "text").mapInArrow(_counted, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
        where = {x: i for i, x in enumerate(languages)}
        counts[rows["bucket"].to_numpy(np.int64), rows["label"].map(where).to_numpy(np.int64)] += rows["n"].to_numpy(float)
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


_SCORES = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("host", pa.string()), ("markup", pa.string()), ("address", pa.string()), ("n_grams", pa.int64()), ("scores", pa.list_(pa.float64())), ("own", pa.list_(pa.float64()))])
_SCORES_DDL = "doc_id long, row_key long, host string, markup string, address string, n_grams long, scores array<double>, own array<double>"


def _scored(shared):
    """For mapInArrow: the text's log likelihoods, and ``own``, the languages' shares in it by text alone (all 0 without letters)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights
        width = weights.shape[1]
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column("text"), 1 << 20):
                text, bucket = trigrams(data, offsets)
                rows = end - row
                n = np.bincount(text, minlength=rows)
                total = np.stack([np.bincount(text, weights[bucket, i], minlength=rows) for i in range(width)], axis=1).astype(float) if width else np.zeros((rows, 0))
                total *= (np.maximum(n, 1) ** (TEMPER - 1))[:, None]
                own = np.exp(total - total.max(axis=1, keepdims=True)) if width else total
                own *= ((n > 0) / own.sum(axis=1))[:, None] if width else 1
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(x.ravel())) for x in (total, own)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, rows) for c in ("doc_id", "row_key", "host", "markup", "address")), pa.array(n.astype(np.int64)), *lists], schema=_SCORES)

    return run


def identified(docs: DataFrame, model: Model, host: str | None = None, url: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, row_key, language, confidence, n_grams and kept of each row. host: a column of hosts; url: one of addresses."""
    spark = docs.sparkSession
    names, width = model.languages, len(model.languages)
    body = F.col(text)
    is_page = body.rlike(PAGE)
    markup = F.when(is_page, F.nullif(F.lower(F.regexp_extract(body, r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit("")))
    address, of = F.lit(None).cast("string"), F.col(host) if host else F.lit(None).cast("string")
    if url:
        of = F.coalesce(of, host_of(F.col(url)))
        path = F.nullif(F.regexp_extract(url, r"://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1), F.lit(""))
        address = F.when(path.isin(names), path)
    suffixes = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    address = F.coalesce(address, F.when(of.contains("."), F.try_element_at(suffixes, F.substring_index(of, ".", -1))))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("row_key"), F.when(is_page, F.regexp_replace(F.regexp_replace(body, UNSEEN, " "), r"<[^>]*>", " ")).otherwise(body).alias("text"), of.alias("host"), markup.alias("markup"), address.alias("address"))
    scores = staged(rows.mapInArrow(_scored(spark.sparkContext.broadcast(model)), _SCORES_DDL), "scores")
    if not width:
        return scores.select("doc_id", "row_key", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), "n_grams", F.lit(False).alias("kept"))

    # priors: shares by text alone, summed for each host, for each domain and for all; each document's own part is taken out again
    own = [F.get("own", F.lit(i)) for i in range(width)]
    looks = scores.where("n_grams > 0").withColumn("domain", F.substring_index("host", ".", -2))
    hosts = staged(looks.where("host is not null").groupBy("host", "domain").agg(F.count("*").alias("n_h"), *[F.sum(x).alias(f"h{i}") for i, x in enumerate(own)]), "hosts")
    domains = hosts.groupBy("domain").agg(F.sum("n_h").alias("n_d"), *[F.sum(f"h{i}").alias(f"d{i}") for i in range(width)])
    n_all, *total = (x or 0.0 for x in looks.agg(F.count("*"), *[F.sum(x) for x in own]).first())
    mine = F.when(F.col("n_grams") > 0, 1).otherwise(0)  # how many documents own is

    def others(i: int, counts, n, above, strength: float):
        """The share of language i among the other documents, smoothed towards the share above."""
        return (F.greatest(counts - own[i], F.lit(0.0)) + strength * above) / (n - mine + strength)

    def prior(i: int):
        p = others(i, F.lit(total[i]), F.lit(n_all), F.lit(1.0 / width), float(width))
        p = others(i, F.coalesce(f"d{i}", own[i]), F.coalesce("n_d", mine), p, STRENGTH)
        return F.log(others(i, F.coalesce(f"h{i}", own[i]), F.coalesce("n_h", mine), p, STRENGTH))

    def speaks(column: str, right: float):
        wrong = (1 - right) / max(1, width - 1)
        return [F.when(F.col(column).isin(names), F.when(F.col(column) == x, np.log(right)).otherwise(float(np.log(wrong)))).otherwise(0.0) for x in names]

    joined = scores.join(hosts.join(domains, "domain"), "host", "left")
    logs = [F.get("scores", F.lit(i)) + prior(i) + a + b for i, (a, b) in enumerate(zip(speaks("markup", MARKUP_RIGHT), speaks("address", ADDRESS_RIGHT), strict=True))]
    joined = joined.select("doc_id", "row_key", "n_grams", *[x.alias(f"l{i}") for i, x in enumerate(logs)])
    each = [F.col(f"l{i}") for i in range(width)]
    joined = joined.withColumn("top", F.greatest(*each) if width > 1 else each[0])
    said, language = F.col("n_grams") > 0, F.lit(names[-1])
    for name, x in reversed(list(zip(names, each, strict=True))):
        language = F.when(x == F.col("top"), name).otherwise(language)
    joined = joined.withColumn("best", 1 / sum((F.exp(x - F.col("top")) for x in each), F.lit(0.0)))
    best, language, confidence = F.col("best"), F.when(said, language), F.when(said, F.round("best", 6)).otherwise(0.0)
    return joined.select("doc_id", "row_key", language.alias("language"), confidence.alias("confidence"), "n_grams", (said & (best >= LEAST)).alias("kept"))


def page_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Languages of pages, by text, markup, address and host; the model is that of the labelled documents."""
    return identified(pages, fit(docs), url="url", text="html", key="page_id").select(F.col("doc_id").alias("page_id"), "language", "confidence", "n_grams", "kept")


def language_report(docs: DataFrame) -> DataFrame:
    """Languages of documents; their source is their host."""
    return identified(docs, fit(docs), host="source").drop("row_key")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    gone = identified(docs, fit(docs), host="source").where("not kept").select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_doc"]) & (F.xxhash64(docs["text"]) == gone["_key"]), "left_anti")
