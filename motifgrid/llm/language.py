"""Operator 8: language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes one space, and character n-grams of one to
three are hashed into BUCKETS. Training counts n-grams by language over all training rows (at most
languages * BUCKETS rows leave a partition, and as many reach the driver, once); the log-probability matrix (BUCKETS rows, a
column a language) is broadcast. Scoring takes the rows of a text's n-grams and adds them up, for many
texts at once.

Defined results: null texts and texts without a letter are `und` with a score of 0, as is every text
if nothing was learned; of equal scores the first language by name wins; a row without a language or a
text isn't learned from; repeated rows count as often as they occur; a null doc_id counts as text ''. Predictions use the
text alone. The score is the posterior probability of the language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, fresh, pieces, texts

BUCKETS, ORDERS = 1 << 14, (1, 2, 3)
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, text by text, and where each text's begin (n + 1 places)."""
    at = np.zeros(len(batch) + 1, np.int64)
    lowered = [x.lower() for x in batch]
    np.cumsum([len(x) + 1 for x in lowered], out=at[1:])
    code = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[code]
    first = np.zeros(len(code), bool)
    first[at[:-1][at[:-1] < len(code)]] = True
    keep = letter | np.concatenate([[False], letter[:-1]]) & ~first
    code = np.where(letter, code, 32)[keep].astype(np.uint32)
    begins = np.concatenate([[0], np.cumsum(keep)])[at]
    last = np.repeat(begins[1:], np.diff(begins))
    parts, owner = [], []
    mixed = np.zeros(len(code), np.uint32)
    for n in ORDERS:
        if n > len(code):
            break
        mixed = (mixed[: len(code) - n + 1] ^ code[n - 1 :]) * np.uint32(0x01000193)
        inside = np.arange(len(mixed)) + n <= last[: len(mixed)]
        held = mixed[inside] + np.uint32(n)
        parts.append(((held ^ (held >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(18))
        owner.append(np.searchsorted(begins[1:], np.flatnonzero(inside), side="right"))
    if not parts:
        return np.empty(0, np.int64), np.zeros(len(batch) + 1, np.int64)
    owners, buckets = np.concatenate(owner), np.concatenate(parts)
    order = np.argsort(owners, kind="stable")
    return buckets[order].astype(np.int64), np.searchsorted(owners[order], np.arange(len(batch) + 1))


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name and the log-probability matrix (BUCKETS + 1, languages); the last row holds priors."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text", 1 << 18):
            buckets, begins = ngrams(texts(batch.column("text")))
            langs = np.array(batch.column("lang").to_pylist())
            whose = np.repeat(np.arange(len(langs)), np.diff(begins))
            for lang in np.unique(langs):
                found = held.setdefault(str(lang), np.zeros(BUCKETS + 1, np.int64))
                found[:BUCKETS] += np.bincount(buckets[(langs == lang)[whose]], minlength=BUCKETS)
                found[BUCKETS] += int((langs == lang).sum())
        for lang, found in held.items():
            full = np.flatnonzero(found)
            yield batch_of(schema, lang=[lang] * len(full), bucket=full.astype(np.int32), n=found[full])

    known = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    n = np.zeros((BUCKETS + 1, len(langs)))
    n[counts["bucket"], [langs.index(x) for x in counts["lang"]]] = counts["n"]
    if not langs:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    grams = n[:BUCKETS] + 0.5
    return langs, np.concatenate([np.log(grams / grams.sum(axis=0)), np.log(n[BUCKETS:] / n[BUCKETS:].sum())]).astype(np.float32)


def predict(batch: list[str], langs: list[str], model: np.ndarray) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(batch), [0.0] * len(batch)
    buckets, begins = ngrams(batch)
    n = np.diff(begins)
    full = np.flatnonzero(n)
    if not langs or not len(full):
        return names, scores
    logs = np.add.reduceat(model[buckets], begins[full], axis=0, dtype=np.float64) + model[-1]
    best = logs.argmax(axis=1)
    part = np.exp(logs - logs.max(axis=1, keepdims=True))
    part /= part.sum(axis=1, keepdims=True)
    for i, b, p in zip(full.tolist(), best.tolist(), part, strict=True):
        names[i], scores[i] = langs[b], float(p[b])
    return names, scores


def identified(docs: DataFrame, learned: tuple[list[str], np.ndarray], keep: list[str], lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns `keep` of docs with the predicted language and its score, under the given names."""
    spark, name = docs.sparkSession, fresh(keep, "__text")
    held = spark.sparkContext.broadcast(learned)  # BUCKETS rows, a column a language
    rows = docs.select(*[docs[k] for k in keep], docs["text"].alias(name))
    spec = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes[:-1]) + f", `{lang}` string, `{score}` double"

    def run(batches):
        for batch in pieces(batches, name, 1 << 18):
            names, scores = predict(texts(batch.column(name)), *held.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], lang, score])

    return rows.mapInArrow(run, spec)


def held_out(docs: DataFrame):
    """Whether a row is kept from training: CRC-32 of doc_id as text, modulo 3, is 1."""
    return F.crc32(F.encode(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), "utf-8")) % 3 == 1


def language_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    learned = train(docs.filter(~held_out(docs)).select("lang", "text"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs).alias("held_out"), docs["text"].alias("text"))
    return identified(rows, learned, ["doc_id", "held_out"])
