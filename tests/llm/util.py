"""Small odd tables for the tests of the training-data operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, **extra):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD_TEXTS = [
    None,
    "",
    " ",
    "a",
    "the the the",
    "!!! ??? 123",
    "  two  spaces\n\n\nand\tlines \n",
    "é" * 70,
    "ß ñ ü 日本語 テキスト 😀😀 مرحبا",
    "it's we'll they've I'm x'd ''s 's!'s \n's",
    "word " * 3000,
    "a" * 20000,
    " " * 3000 + "x",
    "the the the",
]
