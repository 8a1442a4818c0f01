"""Small tables with every awkward case, and generators of prose."""

import random

WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty knoll larch meadow north oasis plume quartz ridge spruce tundra umber valley willow yarrow zephyr".split()


def prose(seed, words, per_line=12):
    rng = random.Random(seed)
    out = [rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(words)]
    return "\n".join(" ".join(out[i : i + per_line]) for i in range(0, words, per_line))


def long_line(k):
    return f"A line number {k} that is long enough for anyone to call it long."


def awkward_texts():
    """Texts that break careless code: null, empty, blank, very long, without spaces, in other scripts."""
    return [
        None,
        "",
        " ",
        "\n\n",
        "word",
        "  \t\x0b\x0c\r\n ",
        "x" * 60_000,
        "héllo wörld ÀÉ İstanbul ﬁ   　 日本語 текст 😀😀 don't I'LL we've",
        "tabs\tand\r\nfeeds   and    runs of spaces  \n   \n end ",
        "<|endoftext|> inside <|startoftext|> and <|endoftext|>  after",
        prose(1, 4000),
        "a\x00b\x01c \x1c\x1d\x85 \xa0 z",
        ("Café 123,456.78 -- !!! " * 500),
        prose(2, 30),
        prose(2, 30),
        " " * 40 + "y" * 5,
        " " * 40_000 + "z",
        "ab" * 30_000 + " tail of it",
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, rk string, TEXT string, _doc int, _rk int, h1 string"


def documents(spark, rows, parts=3):
    """rows: (doc_id, text). With more columns, some of whose names operators might use themselves."""
    data = [(i, t, "en", "web", None if t is None else len(t), "d", "r", "other", 7, 8, "h") for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts) if data else spark.createDataFrame([], SCHEMA)


def awkward_documents(spark):
    rows = [(k + 1, t) for k, t in enumerate(awkward_texts())]
    rows += [(3, " "), (14, prose(2, 30)), (14, prose(3, 30)), (None, "no id but words enough to make shingles here"), (None, None)]
    return rows, documents(spark, rows)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
