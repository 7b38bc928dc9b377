from lexloom.operators import relate


def test_route_finds_names_next_to_punctuation_and_inflected(spark):
    preambles = [
        "Das Dokumentgesetz, zuletzt geändert", "(Dokumentgesetz", "Artikel des\nDOKUMENTGESETZES", "Dokument Gesetz", "Das Gesetz über Akten-Führung.", "Die ZPO.", "", None,
    ]
    names = ["Dokumentgesetz", "gesetz über Akten", "ZPO", "GO", None]
    articles = spark.createDataFrame(list(enumerate(preambles)), "article int, preamble string")
    laws = spark.createDataFrame([(n,) for n in names], "law string")
    got = sorted((r["article"], r["law"]) for r in relate.route(articles, "preamble", laws, "law").collect())
    assert got == sorted((k, n) for k, p in enumerate(preambles) for n in names if p is not None and n is not None and n.lower() in p.lower())
    assert len(got) == 5
    assert relate.route(articles, "preamble", laws, "law").columns == ["article", "preamble", "law"]
