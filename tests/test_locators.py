import pytest

from lexloom.functions import locator as L
from lexloom.functions.labels import expand, is_successor, natural, predecessor
from lexloom.functions.sentences import half_sentence_span, numbered, sentence_span, sentences


@pytest.mark.parametrize(
    ("phrase", "units"),
    [
        ("§ 20 Absatz 6 Satz 1", ["§ 20 Absatz 6 Satz 1"]),
        ("§ 3 Absatz 1 Satz 2 und Absatz 4", ["§ 3 Absatz 1 Satz 2", "§ 3 Absatz 4"]),
        ("Absatz 1 und 5", ["Absatz 1", "Absatz 5"]),
        ("In Absatz 1 Satz 1 und 2", ["Absatz 1 Satz 1", "Absatz 1 Satz 2"]),
        ("Art. 19 und 20 Satz 1", ["Art. 19", "Art. 20 Satz 1"]),
        ("Die bisherigen Absätze 2 bis 4", ["Absatz 2", "Absatz 3", "Absatz 4"]),
        ("§§ 3, 4 und 6", ["§ 3", "§ 4", "§ 6"]),
        ("§ 14 Abs. 3 Satz 1 Nr. 3", ["§ 14 Absatz 3 Satz 1 Nummer 3"]),
        ("Buchstaben a bis c", ["Buchstabe a", "Buchstabe b", "Buchstabe c"]),
        ("§ 2 Nummer 1 Buchstabe a Doppelbuchstabe bb", ["§ 2 Nummer 1 Buchstabe a Buchstabe bb"]),
        ("der Überschrift des Abschnitts 2", ["Überschrift Abschnitt 2"]),
        ("dem Zweiten Abschnitt", ["Abschnitt 2"]),
        ("Anlage 2 Nummer 3", ["Anlage 2 Nummer 3"]),
        ("§ 5 Absatz 1 letzter Satz", ["§ 5 Absatz 1 Satz letzter"]),
        ("In der Inhaltsübersicht", ["Inhaltsübersicht"]),
        ("§ 3 im Satzteil vor Nummer 1", ["§ 3"]),
        ("Die Anlage zu § 2 Absatz 4 Satz 1", ["Anlage"]),
        ("Ausbildungsabschnitt 1 Absatz 2", ["Ausbildungsabschnitt 1 Absatz 2"]),
        ("Unterabschnitt 4", ["Unterabschnitt 4"]),
        ("Absatz 2 in dem Satzteil nach Nr. 3", ["Absatz 2"]),
        ("Hausnummer 3", []),
        ("§ 3 oder so ähnlich", []),
    ],
)
def test_phrases(phrase, units):
    assert [L.show(x) for x in L.parse_many(phrase)] == units


def test_a_coordinated_phrase_is_not_one_unit():
    assert L.parse("§ 3 und § 4") is None


@pytest.mark.parametrize(
    ("context", "found", "whole"),
    [
        ("§ 2 Absatz 1", "Satz 2", "§ 2 Absatz 1 Satz 2"),
        ("§ 14", "Nummer 5", "§ 14 Nummer 5"),
        ("§ 2 Absatz 1 Nummer 3", "Nummer 4", "§ 2 Absatz 1 Nummer 4"),
        ("§ 2 Absatz 1", "§ 3", "§ 3"),
        ("§ 2 Absatz 1 Satz 2", "Absatz 3", "§ 2 Absatz 3"),
        ("Inhaltsübersicht", "§ 9", "Inhaltsübersicht § 9"),
    ],
)
def test_context_completes(context, found, whole):
    assert L.show(L.within(L.parse(context), L.parse(found))) == whole


def test_labels():
    assert all(is_successor(a, b) for a, b in (("2", "2a"), ("2a", "2b"), ("2b", "3"), ("a", "b"), ("a", "a1"), ("a2", "b"), ("aa", "bb"), ("i", "ii"), ("6.1", "6.2")))
    assert not any(is_successor(a, b) for a, b in (("2", "4"), ("a", "c"), ("aa", "cc"), ("1", "18")))
    assert sorted(["10a", "9", "11", "10"], key=natural) == ["9", "10", "10a", "11"]
    assert expand("2", "5") == ["2", "3", "4", "5"] and expand("a", "c") == ["a", "b", "c"] and expand("3a", "3c") == ["3a", "3b", "3c"] and expand("aa", "cc") is None
    assert [predecessor(x) for x in ("4", "3a", "3b", "c", "bb", "1", "a")] == ["3", "3", "3a", "b", "aa", None, None]
    assert L.point_path("Nummer 8 Buchstabe a Doppelbuchstabe bb") == "8. a) bb)"


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("Ein Satz. Noch einer.", ["Ein Satz.", "Noch einer."]),
        ("Nach § 3 Abs. 2 Nr. 4 Buchst. a gilt dies. Mehr.", ["Nach § 3 Abs. 2 Nr. 4 Buchst. a gilt dies.", "Mehr."]),
        ("Bis zum 3. Juni 2020 gilt dies. Dann nicht.", ["Bis zum 3. Juni 2020 gilt dies.", "Dann nicht."]),
        ("Er sagt „Ja.“ Sie (nein). § 4 gilt.", ["Er sagt „Ja.“", "Sie (nein).", "§ 4 gilt."]),
        ("¹Ein Satz. ²Noch einer", ["¹Ein Satz.", "²Noch einer"]),
        ("Es umfasst\n  1. Lesen und\n  2. Schreiben. Danach Schluss.", ["Es umfasst\n  1. Lesen und\n  2. Schreiben.", "Danach Schluss."]),
        ("Das 2. Kapitel gilt. Es endet 2020. Dann neu.", ["Das 2. Kapitel gilt.", "Es endet 2020.", "Dann neu."]),
        ("Eine Fußnote⁶) steht hier. Ende.", ["Eine Fußnote⁶) steht hier.", "Ende."]),
    ],
)
def test_sentences(text, parts):
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_sentence_places():
    text = "¹A ist. ³B ist."
    assert sentence_span(text, "3") and sentence_span(text, "2") is None  # official numbers, no fallback to places
    assert sentence_span("A ist. B ist. C.", "letzter") == (14, 16)
    assert half_sentence_span("Dies gilt; jenes nicht.", "2") == (11, 23) and half_sentence_span("Ohne.", "1") is None
    assert numbered("A ist. B ist.") == "¹A ist. ²B ist."


def test_phrases_without_a_unit():
    assert all(L.names_nothing(x) for x in ("in dem Satzteil nach Nr. 3", "In der Einleitung", "Im Eingangssatz", "dem Wortlaut"))
    assert not L.names_nothing("In der Einleitungsformel")


@pytest.mark.parametrize("text", ["Es gilt z. B. Der Rest", "Es gilt u. U. Der Rest", "nach § 3 insbes. Die Frist", "nach Doppelbuchst. Aa gilt", "im RGBl. I veröffentlicht"])
def test_abbreviations_end_no_sentence(text):
    assert len(sentences(text)) == 1


def test_capitals_that_are_no_abbreviation_end_a_sentence():
    assert len(sentences("Es gilt Tarif B. Der Rest folgt.")) == 2


def test_long_ranges_keep_every_label():
    assert expand("1", "150") == [str(k) for k in range(1, 151)] and expand("9", "3") is None
    assert len(L.parse_many("§§ 1 bis 150")) == 150
