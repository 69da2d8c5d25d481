"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior: the likelihood of the whole text under
character n-gram models, the language that markup or metadata declares, the address
suffix, and the host. The priors of suffixes and hosts come from grouped aggregation over
the whole corpus and are smoothed down a hierarchy: all documents, suffix, host.

Where only ids are asked for, evidence is computed once and written without the texts.
Where whole rows are, it is computed for the priors and again for the rows, so that no
second copy of the texts is ever written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, chunks_of, column, hot_keys, materialise, partitions, release, rows_back, send_back

LANGUAGES = ("de", "en", "es", "fr")
#: Function words that a model knows before any training.
SEEDS = {
    "de": "der die das und ist nicht ein eine zu den mit von für auf im dem sich auch als wie wird bei nach über ich wir sind war",
    "en": "the and of to in is that it was for on are with as his they be at one have this from or had by not but what all were",
    "es": "el la los las de que y en un una ser se no haber por con su para como estar tener le lo más pero sus sobre este ya muy",
    "fr": "le la les de des et un une est que pas pour dans qui sur se ce au plus par avec sont nous vous mais ou être était ne du",
}
#: Rows of the labelled sample and bytes of each, pseudo-count of an n-gram, bits of an n-gram's bucket, weight of the function words.
TRAIN_ROWS, TRAIN_BYTES, ALPHA, BUCKET_BITS, SEED_WEIGHT = 1000, 20_000, 0.5, 17, 20
#: Weight of an n-gram's log-likelihood (they overlap).
TEMPER = 0.5
#: How often a declared language is right; documents that a suffix's or host's prior counts as.
DECLARED_RIGHT, SUFFIX_WEIGHT, HOST_WEIGHT = 0.9, 20.0, 20.0
#: A document is kept with at least this posterior and share of known n-grams.
LEAST_POSTERIOR, LEAST_KNOWN = 0.5, 0.3
#: Bytes of a text whose n-grams are looked up together.
SLICE = 1 << 19
#: Hosts whose priors are broadcast; more are joined by salted keys.
BROADCAST_HOSTS = 200_000
#: Bytes that are letters: a-z and all of non-ASCII characters.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def letters_of(text: str | None) -> bytes:
    """Lower-cased words of letters with single spaces between and around; empty without any."""
    words = ascii_lower(text).translate(LETTERS).split()
    return b" " + b" ".join(words) + b"  " if words else b""


def buckets(letters: bytes) -> np.ndarray:
    """Buckets of the runs of three bytes that begin at each place but the last two."""
    a = np.frombuffer(letters, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.uint32)
    key = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


@dataclass(frozen=True)
class TextModel:
    """Log-likelihoods of hashed character n-grams by language, against their mean; a last column is 1 for known ones."""

    languages: tuple[str, ...]
    table: np.ndarray

    @classmethod
    def train(cls, rows: Iterator[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES, alpha: float = ALPHA) -> TextModel:
        """From (language, text); languages that aren't listed are passed over."""
        counts = np.zeros((len(languages), 1 << BUCKET_BITS))
        for i, name in enumerate(languages):
            counts[i] += SEED_WEIGHT * np.bincount(buckets(letters_of(SEEDS.get(name, ""))), minlength=1 << BUCKET_BITS)
        place = {name: i for i, name in enumerate(languages)}
        for name, text in rows:
            if name in place:
                np.add.at(counts[place[name]], buckets(letters_of(text)), 1.0)
        logs = np.log((counts + alpha) / (counts.sum(1, keepdims=True) + alpha * (1 << BUCKET_BITS)))
        known = counts.sum(0) > 0
        logs = np.where(known, logs - logs.mean(0), 0.0)
        return cls(languages, np.vstack([logs, known]).T.astype(np.float32).copy())

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """A row a text: tempered log-likelihoods, 0 for the best, then the share of n-grams that are known."""
        n = len(self.languages)
        parts = [letters_of(t) for t in texts]
        if any(len(p) > SLICE for p in parts) and len(parts) > 1:
            return np.vstack([self.evidence([t]) for t in texts])
        sizes = np.array(list(map(len, parts)))
        out = np.zeros((len(texts), n + 1))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            if sizes.max() > SLICE:  # one long text, a slice at a time
                sums = sum(self.table[buckets(parts[0][i : i + SLICE + 2])].sum(0, dtype=np.float64) for i in range(0, len(parts[0]), SLICE))[None, :]
            else:
                found = self.table[buckets(b"".join(parts) + b"  ")]
                ends = np.cumsum(sizes)[full]
                found[np.concatenate([ends - 2, ends - 1])] = 0.0  # what begins there goes on into the next text
                sums = np.add.reduceat(found, starts, axis=0, dtype=np.float64)
            scores = sums[:, :n]
            out[full, :n] = TEMPER * (scores - scores.max(1, keepdims=True))
            out[full, n] = sums[:, n] / (sizes[full] - 2)
        return out


def train_on(docs: DataFrame, text_col: str = "text", label_col: str = "lang", languages: tuple[str, ...] = LANGUAGES, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> TextModel:
    """Fits the text model on a bounded sample of labelled rows: those whose text has a small hash, texts of at most most_bytes.

    About rows of them, at most twice as many, so 2 * rows * most_bytes bytes at most
    reach the driver. Without labels the function words alone count.
    """
    if not label_col or label_col not in docs.columns:
        return TextModel.train(iter(()), languages)
    labelled = docs.select(column(label_col).cast("string").alias("l"), column(text_col).alias("t")).where(F.col("l").isin(*languages))
    share = min(1.0, rows / max(1, labelled.count()))
    small = F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = labelled.where(small & (F.octet_length("t") <= most_bytes)).limit(2 * rows).collect()
    return TextModel.train(((r.l, r.t) for r in sample), languages)


def text_evidence(docs: DataFrame, model: TextModel, text: Column) -> Column:
    """array<double>: tempered log-likelihoods of the whole text, then the share of n-grams that are known."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def evidence(texts: pa.Array) -> pa.Array:
        release()
        rows = [shared.value.evidence(part) for part in chunks_of(texts, 1 << 18)]
        flat = np.concatenate(rows) if rows else np.zeros((0, len(shared.value.languages) + 1))
        offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.reshape(-1)))

    return evidence(text)


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs)
    exps = [F.exp(x - top) for x in logs]
    return [e / sum(exps[1:], exps[0]) for e in exps]


def declared_language(text: Column, declared: Column | None, languages: tuple[str, ...]) -> Column:
    """What the markup of the text says, else what the metadata says; null if neither names a known language."""
    tag = F.lower(F.regexp_extract(text, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})\b", 1))
    meta = F.lower(F.substring(declared, 1, 2)) if declared is not None else F.lit(None).cast("string")
    return F.coalesce(F.when(tag.isin(*languages), tag), F.when(meta.isin(*languages), meta))


def address(value: Column) -> tuple[Column, Column]:
    """Host and last label of a URL or a plain source name; the suffix is empty without a dot."""
    host = F.lower(F.regexp_extract(F.coalesce(value, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)", 1))
    return host, F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise("")


def identify(docs: DataFrame, model: TextModel | None = None, text_col: str = "text", declared_col: str | None = "lang", address_col: str | None = "source", languages: tuple[str, ...] = LANGUAGES, keep: str | None = None) -> DataFrame:
    """Each whole row of docs, as struct "row", with language, posterior, text_language, declared, host, known, accepted.

    With keep, "row" is that column alone. accepted is false for
    documents without words, with a posterior below LEAST_POSTERIOR, or with less than
    LEAST_KNOWN of their n-grams known; language is "und" for those. Null texts count as
    empty, null addresses as the empty host, unknown declarations as none. Ties go to the
    language listed first. Repeated rows give repeated results and count again in priors;
    an empty table gives an empty one; columns of docs can have any names and types,
    they stay within "row".
    """
    known_cols = set(docs.columns)
    declared_col = declared_col if declared_col in known_cols else None
    address_col = address_col if address_col in known_cols else None
    model = model or train_on(docs, text_col, declared_col or "", languages)
    text = F.coalesce(column(text_col), F.lit(""))
    host, suffix = address(column(address_col).cast("string") if address_col else F.lit(""))
    declared = declared_language(text, column(declared_col).cast("string") if declared_col else None, languages)
    right, wrong = math.log(DECLARED_RIGHT), math.log((1 - DECLARED_RIGHT) / (len(languages) - 1))
    row = column(keep) if keep else F.struct(*map(column, docs.columns))
    rows = docs.select(row.alias("row"), host.alias("host"), suffix.alias("suffix"), declared.alias("declared"), text_evidence(docs, model, column(text_col)).alias("evidence"))
    rows = materialise(rows, "language-evidence") if keep else rows
    said = lambda name: F.when(F.col("declared").isNull(), 0.0).when(F.col("declared") == name, right).otherwise(wrong)
    logs = [F.col("evidence")[i] + said(name) for i, name in enumerate(languages)]

    # priors: expected documents of each language by host, then by suffix, then in all
    worth = F.col("evidence")[len(languages)] >= LEAST_KNOWN
    own = rows.select("host", "suffix", *[F.when(worth, p).otherwise(0.0).alias(name) for name, p in zip(languages, _softmax(logs))])
    hosts = materialise(own.groupBy("host", "suffix").agg(F.count("*").alias("docs"), *[F.sum(name).alias(name) for name in languages]), "host-languages")
    whole = hosts.agg(F.count("*").alias("hosts"), F.sum("docs").alias("docs"), *[F.sum(name).alias(name) for name in languages]).first()
    total = sum(whole[name] or 0.0 for name in languages)
    base = [((whole[name] or 0.0) + 1.0) / (total + len(languages)) for name in languages]

    def smoothed(counts: list[Column], above: list[Column], weight: float) -> list[Column]:
        return [(c + weight * a) / (sum(counts[1:], counts[0]) + weight) for c, a in zip(counts, above)]

    by_suffix = hosts.groupBy("suffix").agg(*[F.sum(name).alias(f"s_{name}") for name in languages])
    suffix_prior = smoothed([F.col(f"s_{name}") for name in languages], [F.lit(b) for b in base], SUFFIX_WEIGHT)
    host_prior = smoothed([F.col(name) for name in languages], suffix_prior, HOST_WEIGHT)
    priors = hosts.join(by_suffix, "suffix").select("host", F.array(*host_prior).alias("prior"))
    if whole["hosts"] <= BROADCAST_HOSTS:
        met = rows.join(F.broadcast(priors), "host")
    else:  # the same join, by keys that are salted where a host holds many rows
        salts = max(8, partitions(docs.sparkSession))
        met = send_back(rows, "host", priors, hot_keys(hosts.select("host", "docs"), whole["docs"], salts, "docs"))
    posterior = _softmax([x + F.log(F.col("prior")[i]) for i, x in enumerate(logs)])
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-i).alias("i")) for i, p in enumerate(posterior)]))
    text_best = F.array_max(F.array(*[F.struct(F.col("evidence")[i].alias("p"), F.lit(-i).alias("i")) for i in range(len(languages))]))
    names = F.array(*map(F.lit, languages))
    judged = met.select("row", "host", "declared", F.col("evidence")[len(languages)].alias("known"), best.alias("best"), text_best.alias("text_best"))
    accepted = (F.col("known") >= LEAST_KNOWN) & (F.col("best.p") >= LEAST_POSTERIOR)
    return judged.select(
        "row", F.when(accepted, F.element_at(names, 1 - F.col("best.i"))).otherwise("und").alias("language"), F.col("best.p").alias("posterior"),
        F.element_at(names, 1 - F.col("text_best.i")).alias("text_language"), "declared", "host", "known", accepted.alias("accepted"),
    )


def identify_languages(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each row of docs: id, language, posterior, text_language, declared, host, known, accepted (see identify)."""
    return identify(docs, keep=id_col, **options).select(F.col("row").alias(id_col), "language", F.round("posterior", 6).alias("posterior"), "text_language", "declared", "host", F.round("known", 6).alias("known"), "accepted")


def with_known_language(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, whose language is accepted."""
    return rows_back(identify(docs, **options).where("accepted"))
