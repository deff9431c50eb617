"""Token counts, kept under digests of texts and tokenizers.

A count is stored under the digest of the text and that of the tokenizer: its
file, library, library version and options. A run looks its distinct texts up
in the store, encodes those that are missing, once each, and appends them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, doc_ids, materialize

#: Characters that are encoded at a time, at most, where a text can be cut without another count.
PART = 1_000_000
#: Missing texts up to which their digests are broadcast, to let only their rows into the shuffle.
MISSING = 1_000_000
STORED = "content binary, n_tokens long, tokenizer string"


@dataclass(frozen=True)
class Tokenizer:
    """A public tokenizer: its file as the driver reads it, and a function that makes an encoder of it in a task.

    ``normal`` takes a text to the form that is counted; it must not change the
    count, and stands for more equal texts the better.
    """

    data: bytes
    version: str
    encoder: Callable[[bytes], Callable[[list[str]], list[int]]]
    normal: Callable[[Column], Column] = lambda text: text

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.version.encode() + b"\0" + self.data).hexdigest()


def _parts(text: str, most: int) -> list[str]:
    """A text cut before spaces that follow another character; the space itself is left out, as a beginning gets one."""
    out, begin = [], 0
    while len(text) - begin > most:
        at = begin + most
        while at < len(text) and not (text[at] == " " and text[at - 1] not in " ▁"):
            at += 1
        if at + 1 >= len(text):  # a last space alone would get no sign of its own
            break
        out.append(text[begin:at])
        begin = at + 1
    return [*out, text[begin:]]


def _piece_encoder(data: bytes, most: int = PART) -> Callable[[list[str]], list[int]]:
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=data)

    def count(texts: list[str]) -> list[int]:
        return [sum(len(own.encode(p)) for p in (_parts(t, most) if t else [])) for t in texts]

    return count


def pieces(path: str) -> Tokenizer:
    """The tokenizer of a sentencepiece model.

    A text over ``PART`` characters is encoded in parts, cut where a space
    follows another character: no piece of the model may go across such a
    place, and the library must put a space at a beginning; else it is refused.
    """
    import sentencepiece

    with open(path, "rb") as f:
        data = f.read()
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    across = any("▁" in own.id_to_piece(i).lstrip("▁") for i in range(own.get_piece_size()))
    if across or own.encode("a b", out_type=str)[0][0] != "▁" or own.normalize(" a  b ") != "▁▁a▁▁b▁":
        raise ValueError(f"texts of {path} cannot be cut at spaces")
    return Tokenizer(data, f"sentencepiece {sentencepiece.__version__} plain", _piece_encoder)


def _json_encoder(data: bytes) -> Callable[[list[str]], list[int]]:
    from tokenizers import Tokenizer as Loaded

    own = Loaded.from_str(data.decode())
    own.no_truncation()
    own.no_padding()

    def count(texts: list[str]) -> list[int]:
        return [len(own.encode(t, add_special_tokens=False)) for t in texts]

    return count


def json_tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a JSON file; texts are encoded whole."""
    import tokenizers

    with open(path, "rb") as f:
        return Tokenizer(f.read(), f"tokenizers {tokenizers.__version__} plain", _json_encoder)


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(content, n_tokens) of a tokenizer in the store; a text that two runs have appended counts once."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    kept = spark.read.schema(STORED).parquet(cache).where(F.col("tokenizer") == version)
    return kept.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def _encoded(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(content, n_tokens) of ``texts`` (content, text)."""
    data, encoder = texts.sparkSession.sparkContext.broadcast(tokenizer.data), tokenizer.encoder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.binary()), pa.array(count(part.column(1).to_pylist()), pa.int64())], names=["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, "content binary, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: Tokenizer, cache: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of ``docs`` (doc_id, text), a row for each row.

    ``cache`` is a folder that all executors share; it is made if it is not
    there, holds any number of tokenizers, and may be used by several runs at a
    time. Null texts are empty and have no tokens; null and repeated doc_ids
    keep their rows, equal texts are encoded once; no rows give no rows. Other
    columns are ignored. Bytes are those of the text itself.
    """
    spark, version = docs.sparkSession, tokenizer.digest
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(doc_ids(docs)[0].alias("doc_id"), text.alias("text")).withColumn("normal", tokenizer.normal(F.col("text")))
    keyed = keyed.withColumn("content", F.unhex(F.sha2("normal", 256)))
    rows = materialize(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "token-rows")
    looked = materialize(rows.select("content").distinct().join(_stored(spark, cache, version), "content", "left"), "token-lookup")
    missing = looked.where("n_tokens is null").select("content")
    n = missing.count()
    if n:
        texts = keyed.select("content", F.col("normal").alias("text"))
        if n <= MISSING:
            texts = texts.join(F.broadcast(missing), "content", "left_semi").dropDuplicates(["content"])
        else:  # one text for each digest and task first, so that a frequent text is no heavy key
            texts = texts.dropDuplicates(["content"]).join(missing, "content", "left_semi")
        new = _encoded(texts, tokenizer).withColumn("tokenizer", F.lit(version))
        new.write.mode("append").partitionBy("tokenizer").parquet(cache)
        found = _stored(spark, cache, version).join(bounded(missing), "content", "left_semi")
        looked = materialize(looked.where("n_tokens is not null").unionByName(found), "token-found")
    counted = rows.join(bounded(looked), "content")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
