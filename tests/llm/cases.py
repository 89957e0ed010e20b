"""Documents with every odd case that operators must stand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, `count` long, shard string"
WORDS = "the quick brown fox jumps over lazy dogs while seven wizards brew potions under pale moonlight near old stone bridges".split()


def prose(i: int, n: int = 60) -> str:
    return " ".join(WORDS[(i * 7 + j * (i % 5 + 1) + j * j) % len(WORDS)] + ("," if j % 9 == 8 else "") for j in range(n))


def rows() -> list[tuple]:
    texts = [
        (1, prose(1)), (2, prose(2) + "\n" + "A line that many documents share here."), (3, "  a line that MANY documents share here.\t\n" + prose(3)),
        (4, "A line that many documents share here.\nA line that many documents share here."), (5, None), (6, ""), (7, " \t\n\n "),
        (8, prose(8)), (9, prose(8)), (10, prose(8) + " indeed"), (11, "été à la plage ! où est-ce que ça va ? " * 4), (12, "\n".join(prose(k, 12) for k in range(300))),
        (13, "12345 67890 !!! ???"), (14, "x"), (15, "🙂 emoji   nbsp \x1c fs"), (16, prose(16) + " <|endoftext|> tail"), (16, prose(17)), (8, prose(8)),
        (None, prose(18)), (None, None), (2**62, prose(19)), (-5, prose(20)),
    ]
    langs, sources = ["en", None, "fr", "de"], ["b", "a", None, "c", "é"]
    return [(d, t, langs[i % 4], sources[i % 5], None if t is None else len(t), "x", i, None) for i, (d, t) in enumerate(texts)]


#: Names that operators use themselves, as columns of the documents.
CLASHING = (
    "row_ id_ text_ fp_ pos_ key_ line_ h1_ h2_ nth_ n_ last_ top_ all_ x_ y_ s_ at_ dropped_ keep_runs_ found_ new_ copies_ rows_ copy_ kept_id_ tree_ "
    "minima_ group_ root_ a_ b_ c_ bucket_ buckets_ whole_ over_ home_ start_ part_ w_ level_ u_ share_ source_key_ doc_idk a b u v m"
).split()


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def documents(spark):
    return with_clashes(spark.createDataFrame(rows(), SCHEMA).repartition(3))


def empty(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))
