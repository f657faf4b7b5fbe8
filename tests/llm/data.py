"""Small odd tables: nulls, empties, long texts, ties, repeated rows and clashing column names."""

from pyspark.sql import types as T

from tagloom.llm.queries import byte_vocabulary, piece_vocabulary

VOCABULARY, PIECES = byte_vocabulary(), piece_vocabulary()

#: Extra columns named like what the operators compute.
_EXTRA = ["h", "fp", "chunk", "length", "piece", "rank", "size", "component_id", "fingerprint", "shard", "slot", "kept", "gone", "root"]

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(name, T.StringType()) for name in _EXTRA],
])

WORDS = "one two three four five six seven eight nine ten eleven twelve a b c d e f g h i j k l m n o p q r s t u v w x y z".split()


def prose(seed: int, words: int) -> str:
    out, x = [], seed * 7919 + 1
    for i in range(words):
        x = (x * 1103515245 + 12345) % 2147483648
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if i % 9 else str(x % 97)))
    return " ".join(out)


TEXTS = [
    prose(1, 60), prose(1, 60), None, "", "   \n\t ", "word", prose(2, 25) + "\n" + prose(3, 25) + "\n" + prose(4, 30),
    prose(5, 10) + "\n" + prose(2, 25) + "\n" + prose(3, 25) + "\n" + prose(4, 30), "x " * 40, "a" * 20000, prose(6, 9000),
    "é ü ñ 漢字 \U0001f600 " * 20, "\n\n\n", "line\n" * 30, prose(7, 100), prose(7, 99) + " changed", "# $ % & | < >" * 8,
    "<|endoftext|> special " + prose(8, 30), "tab\tand\vvertical\fform\rreturn\x1cnot space\x85nor\xa0these " + prose(9, 30),
]


def rows(texts=TEXTS):
    extra = ["clash"] * len(_EXTRA)
    out = [(i, t, ["en", None, "fr", ""][i % 4], ["s1", "s2", None][i % 3], len(t) if t is not None else None, *extra) for i, t in enumerate(texts)]
    out.append(out[0])  # a repeated row
    out.append((None, prose(10, 40), None, None, None, *extra))  # a row without an id
    out.append((3, prose(11, 40), "en", "s1", 0, *extra))  # an id with two texts
    return out


def odd(spark, texts=TEXTS):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
