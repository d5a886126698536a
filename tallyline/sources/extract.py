"""Seams for what reads bytes: PDF extractors and text recognisers (SRC2, SRC4, SRC5).

Neither is part of this engine. An extractor is a function from a file's bytes
to words; a recogniser is a command that prints TSV. Files are handled one by
one in Arrow batches, so memory is that of the largest file.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = "document_id string, page int, ordinal int, text string, box struct<x0:double,y0:double,x1:double,y1:double>, source string, confidence double"
#: The passes of a recogniser: language, page segmentation, and whether only digits and signs are read.
PASSES = (("heb+eng", 6, False), ("eng", 6, False), ("eng", 6, True))
DIGITS = "0123456789.,+-/%$"


def words_of_files(files: DataFrame, extractor: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Words of files (content); ``extractor`` gives (page, text, (x0, y0, x1, y1), source, confidence). The document is the bytes' digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for digest, content in zip(batch["document_id"], batch["content"], strict=True):
                found = extractor(bytes(content))
                rows = [(digest, p, i, t, dict(zip(("x0", "y0", "x1", "y1"), box, strict=True)), s, c) for i, (p, t, box, s, c) in enumerate(found)]
                yield pd.DataFrame(rows, columns=["document_id", "page", "ordinal", "text", "box", "source", "confidence"])

    return files.select(F.sha2("content", 256).alias("document_id"), "content").mapInPandas(run, WORDS)


def recogniser_lines(images: DataFrame, binary: str = "tesseract", dpi: int = 300, timeout: int = 120) -> DataFrame:
    """(document_id, page, pass, line) of a recogniser's output on images (document_id, page, content); read on by ``tsv``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if shutil.which(binary) is None:
            raise RuntimeError(f"{binary} is not installed on this executor")
        for batch in batches:
            for row in batch.itertuples(index=False):
                for number, (language, mode, digits) in enumerate(PASSES):
                    command = [binary, "stdin", "stdout", "-l", language, "--psm", str(mode), "--dpi", str(dpi)]
                    command += ["-c", f"tessedit_char_whitelist={DIGITS}"] if digits else []
                    out = subprocess.run([*command, "tsv"], input=bytes(row.content), capture_output=True, timeout=timeout, check=True).stdout
                    lines = out.decode("utf-8", "replace").splitlines()
                    yield pd.DataFrame({"document_id": row.document_id, "page": row.page, "pass": number, "line": lines})

    return images.select("document_id", "page", "content").mapInPandas(run, "document_id string, page int, pass int, line string")
