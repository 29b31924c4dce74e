"""Small tables with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import pandas as pd

LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(60_000))
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog again and again until the night comes", "en", "a", 10),
    (2, "THE QUICK brown fox jumps over the lazy dog again and again until the night comes", "en", "a", None),
    (3, "", "en", None, 0),
    (4, None, None, "b", None),
    (5, "   \n\t ", "de", "b", 3),
    (6, "one two", "de", "b", 3),
    (7, LONG, "en", "c", 1),
    (8, "Ünïcödé ÀÉ  double  spaces\nand lines <|endoftext|> in it", "fr", "c", 1),
    (9, "same row twice", "en", "d", 1),
    (9, "same row twice", "en", "d", 1),
    (None, "no id at all", "en", "d", 1),
    (None, None, None, None, None),
    (10, "same row twice", "en", "d", 1),
]
EXTRA = ["key", "row", "runs", "hash", "fp", "score", "kept", "label", "held_out", "digest", "rank", "length", "slot", "shard"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows=DOCS):
    """The documents, with extra columns whose names operators use inside."""
    schema = SCHEMA + "".join(f", {name} string" for name in EXTRA)
    return spark.createDataFrame([(*r, *(["x"] * len(EXTRA))) for r in rows], schema)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def read(sf: str, name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{sf}/{name}.parquet")


def texts(sf: str) -> list[tuple[int, str]]:
    frame = read(sf, "documents").sort_values("doc_id")
    return [(int(i), t or "") for i, t in zip(frame["doc_id"], frame["text"])]
