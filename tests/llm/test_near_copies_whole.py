def test_different_texts_of_one_id_stay(spark):
    import corpus_pipeline as P

    text = lambda w: " ".join(f"{w}{i}" for i in range(80))
    rows = [(3, text("a")), (5, text("a") + " end"), (5, text("b")), (5, text("b")), (7, text("b") + " end"), (8, text("c")), (8, text("d")), (None, text("a"))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text) for r in P.near_copies(spark, df, "").collect())
    # of b the id that is not shared is kept
    assert got == sorted([(3, text("a")), (7, text("b") + " end"), (8, text("c")), (8, text("d")), (0, text("a"))])
