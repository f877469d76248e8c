"""Documents: from texts or extracted files to rows of the documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import language, title


def project_documents(df: DataFrame, uri: Column, text: Column, debug: Column | None = None, detect: bool = True, extra: list[str] | None = None) -> DataFrame:
    """Rows of the documents table.

    A null text counts as a failed extraction: an empty text, which is kept with its hash.
    Other columns of ``df`` but those named in ``extra`` are dropped. No shuffle.
    """
    base = df.select(uri.cast("string").alias("pdfUri"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), (debug if debug is not None else F.lit(None)).cast("string").alias("debugInfo"), *(extra or []))
    return base.select(
        "pdfUri", "text", "debugInfo",
        (language(F.col("text")) if detect else F.lit("unknown")).alias("language"),
        title(F.col("text")).alias("title"),
        F.sha2("pdfUri", 256).alias("docId"),
        F.sha2("text", 256).alias("contentHash"),
        *(extra or []),
    )
