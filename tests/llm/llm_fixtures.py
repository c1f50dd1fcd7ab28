import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t()) for n, t in (
    ("doc_id", T.LongType), ("text", T.StringType), ("lang", T.StringType), ("source", T.StringType), ("n_chars", T.LongType))])

#: Names that the operators use inside or for results; clashing columns must do no harm.
CLASH = ("score", "bits", "node", "root", "key", "block", "word", "found", "both", "ids", "rank", "host", "order",
         "n_tokens", "token_ids", "ids_sha256", "decoded_sha256", "__row0", "__tokens0", "__key", "row", "first", "text_")


@pytest.fixture
def docs(spark):
    """Documents from ``(doc_id, text[, lang])``, with further columns of clashing names if asked for."""

    def make(rows, clash=False):
        from pyspark.sql import functions as F

        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df

    return make


@pytest.fixture
def folder(tmp_path):
    """Write tables below a folder that a query or stage can read."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "same text of some words here"), (6, "same text of some words here"),
    (None, "same text of some words here"), (7, "naïve café 中文 🙂 straße"), (8, "long " * 60_000), (9, "x" * 120_000), (9, "x" * 120_000),
]


@pytest.fixture
def odd():
    return ODD
