"""A small table of hard rows, shared by the tests of this folder."""

LONG = "Lorem ipsum, dolor sit amet. " * 4000
TEXTS = [
    None, "", " ", "\n\n", "word", "one two", "a  b", " lead and trail ", "don't 'tis it's", "tab\tand\nline \n end",
    "Ünïcode çà ñ ß ÉÈ", "Łódź żółć 日本語 ไทย", "a b   c", "a \n b", "é J̌", "12,345.67 #1 $$$ %%% |",
    "<|endoftext|> <|startoftext|>", "same text twice here", "same text twice here", "x" * 500, LONG, "\x00\x01 \x1c", "🙂🙂 ok",
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id string, k int"


def hard_documents(spark):
    """Null ids, languages, sources and sizes, repeated rows, and extra columns
    whose names clash with those the operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t) if t else None, 0.5, "x", i)
            for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "no id here", "en", "s", 10, 0.1, "y", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
