"""Functions that give tables, for use from SQL with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.sequence import TEXT_CHUNK, TEXT_OVERLAP, cut_points


class Chunks:
    """The overlapping chunks of a text, as :func:`quarry.operators.sequence.text_chunks` cuts them: ``text_chunks(text)`` or ``text_chunks(text, size, overlap)``."""

    def eval(self, text: str, size: int = TEXT_CHUNK, overlap: int = TEXT_OVERLAP) -> Iterator[tuple[int, int, str]]:
        whole, n = (text or "").strip(), 0
        for a, b in cut_points(whole, size, overlap):
            piece = whole[a:b].strip()
            if piece:
                yield n, a, piece
                n += 1


def register(spark: SparkSession) -> None:
    """Make ``text_chunks`` known to a session's SQL; a null or blank text gives no rows."""
    spark.udtf.register("text_chunks", udtf(Chunks, returnType="chunk bigint, start bigint, text string", useArrow=True))
