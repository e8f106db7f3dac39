"""The split that fitted operators share: rows whose id's checksum is divisible by five are held out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True where crc32(id as text) mod ``folds`` is 0; a null id counts as empty text, so it is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0
