"""Documents with every awkward case that the operators define."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

EXTRA = """fp id root key size bucket score component label secrets redacted quality quality_score quality_posterior language text_hash least_id
row parts times took mixed taken source_size target piece batch slot padded n_tokens first_token fingerprint edited next range tie heavy votes window spans
toxicity lang_pred lang_score dotted.name""".split()


def new_columns(df, docs):
    """The columns that an operator has added to ``docs``: the last ones; the others have to be as they were."""
    assert df.columns[: len(docs.columns)] == docs.columns and len(set(df.columns)) == len(df.columns)
    assert [f.dataType for f in df.schema][: len(docs.columns)] == [f.dataType for f in docs.schema]
    assert all(tuple(r[len(docs.columns) - len(EXTRA) : len(docs.columns)]) == tuple(range(len(EXTRA))) for r in df.collect())
    return df.columns[len(docs.columns) :]

WORDS = [f"w{(7 * k * k + 3 * k) % 101}" for k in range(400)]


def awkward():
    long = " ".join(WORDS * 30)
    passage = " ".join(WORDS[:60])
    return [
        (1, passage, "en", "a", 1),
        (2, passage, "en", "a", 1),
        (3, passage + " tail", "de", "b", None),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \t\n ", "fr", "c", 4),
        (7, "one", "en", "c", 3),
        (7, "one", "en", "c", 3),
        (8, "TWO words", None, None, 9),
        (None, "no id here at all, none", "en", "a", None),
        (9, long, "en", "a", 9),
        (10, "other start " + passage + "\x0b\x0c end é ß 漢字 words", "es", "c", 1),
        (11, "the the the the the " * 40, "en", "b", 1),
    ]


def frame(spark, rows=None, extra=True):
    df = spark.createDataFrame(awkward() if rows is None else rows, DOCS)
    if extra:  # names that operators use inside, or write unless told otherwise
        df = df.selectExpr("*", *[f"{k} as `{name}`" for k, name in enumerate(EXTRA)])
    return df
