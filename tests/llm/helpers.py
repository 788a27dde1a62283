"""Inputs with the odd cases that every operator must take."""

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n a  b\t　c",
    "word",
    "the the the the the the",
    "É<|endoftext|>é ▁x  <s>",
    "Ça va? 'S naïve don't—stop 123 4.5\r\nend ",
    "a\x00b\x1c c",
    "lorem ipsum dolor sit amet " * 3000,
    "x" * 5000,
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=""):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def documents(sf):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf}/documents.parquet").to_pylist()
