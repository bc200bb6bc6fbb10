"""Documents that try every operator: nulls, empty and blank texts, copies, repeated rows, clashing names."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _id string, _text_hash string, _gone int, "
    "shard string, score int, language string, sequence_id int, fp string, n_lines string, label int"
)
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [
    None, "", "   \n\t ", "one", "one two three four five six seven", "one two three four five six seven",
    "Línea ñandú über 12\nsecond line\r\n\nlast", LONG, LONG + " end", "...!!!", "12345 67890",
]


def documents(spark):
    rows = [(i, t, "en" if i % 2 else None, "src0" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "one two three four five six seven", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, "x", "y", 1, "z", 2, "q", 3, "f", "g", 5) for r in rows], SCHEMA).coalesce(2)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
