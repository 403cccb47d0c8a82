"""Small tables with the cases that every corpus operator must define."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, id string, `a.b` int, fingerprint string, copies int"


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, None if text is None else len(text), -1, -2.0, "own", 7, "mine", 9)


LONG = " ".join(f"wort{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    row(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa."), row(2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa."),
    row(3, None), row(4, ""), row(5, "   \n\t "), row(None, "a row without an id but with some words in it"), row(None, None, None, None),
    row(6, "same row twice in the table, word for word"), row(6, "same row twice in the table, word for word"), row(6, "same id, other text"),
    row(7, LONG, "de", "s2"), row(8, LONG, "de", None), row(9, "kurz", None, "ß"), row(10, "tab\there\x0bthere\x0c and \x00 and   and 𝔘nicode é́", "fr", "S1"),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
