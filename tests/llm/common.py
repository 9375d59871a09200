"""A small table of awkward documents."""

CLASHING = "n long, key string, id long, words string, size long, label string, fp string, rep long, item string, pos long, block long, shard long, rejected boolean, held_out boolean, predicted int, quality_score double, lang_pred string, `a.b` string, __gone long, gone long, kept_row string, doc long, cid long"

LOREM = "the quick brown fox jumps over the lazy dog and runs through the green field of barley until the evening sun goes down behind the hills".split()


def awkward(spark, n_words=40):
    """doc_id, text, lang and further columns whose names clash with the operators' own."""
    base = " ".join(LOREM)
    rows = [
        (1, base, "en"), (2, base, "en"), (3, None, None), (4, "", "en"), (5, "   \n\t ", "en"),
        (6, "word", "en"), (7, base + " tail", "en"), (7, base + " tail", "en"), (None, base, None),
        (8, "\n".join([base] * 300), "en"), (9, "Ünïcode ÀÉ straße 12 <|endoftext|> é", "fr"), (10, "\x00\x0b a\x1cb  c", "fr"),
        (11, "42 !!! ???", None), (12, "x" * 5000, "fr"),
    ]
    names = CLASHING.split(", ")
    return spark.createDataFrame([(*r, *[None] * len(names)) for r in rows], "doc_id long, text string, lang string, " + CLASHING)
