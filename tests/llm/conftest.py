import pytest

#: Columns beside those of documents whose names the operators use inside.
EXTRA = {"h": "long", "size": "int", "p": "double", "node": "string", "x": "int", "fp": "long", "row": "int", "words": "int", "shard": "string", "score": "double", "lang_pred": "string", "taken": "int", "k1": "long", "copies": "int", "stratum": "string",
    **{c: "int" for c in ("h_", "k_", "t_", "n_", "i_", "r_", "c_", "copies_", "rows_", "h_own_", "bad_", "lang_pred_", "lang_score", "g", "k", "t", "n", "i", "r", "c", "rows", "H2")}}


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with clashing extra columns."""
    from pyspark.sql import functions as F

    def make(rows, extra=True, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
        return df.withColumns({k: F.lit(77).cast(t) for k, t in EXTRA.items()}) if extra else df

    return make


ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "Two words"), (6, "a b c d"), (None, "no id here at all"), (7, None, None, None),
    (8, "same text of several words here"), (8, "same text of several words here"), (9, "same text of several words here"), (10, "ÄÖÜ ß 日本 \x00 ▁ é"),
    (11, "word " * 30_000), (12, "x" * 50_000), (None, None),
]
