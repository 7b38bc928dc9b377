import pytest

from lexloom.functions import locator as L
from lexloom.plans.recognise import frame, recognise


def read(text, context=""):
    return recognise(text, L.parse(context) or ())


CASES = [
    ("In § 20 Absatz 6 werden die Wörter „alte Fassung“ durch die Wörter „neue Fassung“ ersetzt.", "", "replace", "§ 20 Absatz 6", {"old": "alte Fassung", "new": "neue Fassung", "each": False}),
    ("In § 5 wird jeweils die Angabe „x“ durch die Angabe „y“ ersetzt.", "", "replace", "§ 5", {"each": True}),
    ("In Nummer 16 wird der Punkt am Ende durch ein Komma ersetzt.", "§ 2", "replace", "§ 2 Nummer 16", {"old": ".", "new": ",", "at_end": True}),
    ("In Nummer 5 wird das Komma durch das Wort „und“ ersetzt.", "§ 14", "replace", "§ 14 Nummer 5", {"old": ",", "new": "und", "at_end": False}),
    ("In Satz 2 wird der Punkt am Ende durch ein Komma und die Wörter „sowie mehr“ ersetzt.", "§ 4", "replace", "§ 4 Satz 2", {"new": ", sowie mehr", "at_end": True}),
    ("Die Angabe „§ 9“ wird durch „§ 10“ ersetzt.", "§ 14", "replace", "§ 14", {"old": "§ 9", "new": "§ 10"}),
    ("§ 5 Absatz 1 wird wie folgt gefasst: „(1) Neu.“", "", "redraft", "§ 5 Absatz 1", {"text": "(1) Neu."}),
    ("§ 34a erhält folgende Fassung: „§ 34a Neu“", "", "redraft", "§ 34a", {}),
    ("Die Überschrift wird wie folgt gefasst: „§ 5 Lage“.", "§ 5", "redraft", "§ 5 Überschrift", {}),
    ("§ 19 wird durch den folgenden § 19 ersetzt: „§ 19 Ende.“", "", "redraft", "§ 19", {}),
    ("§ 2 Absatz 2 wird durch die folgenden Absätze 2 und 3 ersetzt: „(2) A. (3) B.“", "", "replace_units", "§ 2 Absatz 2", {"level": L.PARA}),
    ("Nach § 28 wird folgender § 28a eingefügt: „§ 28a Neues (1) Text.“", "", "insert_unit", "§ 28", {"level": L.NORM, "label": "28a", "before": False}),
    ("In Kapitel 4 wird nach § 12 der folgende neue § 13 angefügt: „§ 13 Neu Das gilt.“", "", "insert_unit", "§ 12", {"label": "13"}),
    ("Nach Satz 1 wird folgender Satz eingefügt: „Neu.“", "§ 14 Absatz 1", "insert_unit", "§ 14 Absatz 1 Satz 1", {"level": L.SENTENCE, "label": None}),
    ("Vor den Wörtern „Ende:“ wird folgender Absatz 5 eingefügt: „(5) Neu.“", "§ 3", "insert_unit", "§ 3", {"anchor": ("before", "Ende:"), "label": "5"}),
    ("In Nummer 3 werden nach dem Wort „Daten“ die Wörter „und Namen“ eingefügt.", "§ 1", "insert_words", "§ 1 Nummer 3", {"anchor": ("after", "Daten"), "text": "und Namen"}),
    ("In Nummer 2 werden vor dem Komma am Ende die Wörter „sowie mehr“ eingefügt.", "§ 1", "insert_words", "§ 1 Nummer 2", {"anchor": ("before_comma", "")}),
    ("Folgender Absatz 8 wird angefügt: „(8) Neu.“", "§ 5", "append", "§ 5", {"level": L.PARA, "label": "8"}),
    ("Dem Absatz 6 wird folgender Satz angefügt: „Neu.“", "§ 14", "append", "§ 14 Absatz 6", {"level": L.SENTENCE}),
    ("Dem § 2 wird folgender Absatz 1 vorangestellt: „(1) Neu.“", "", "prepend", "§ 2", {"label": "1"}),
    ("Absatz 3 wird aufgehoben.", "§ 56", "repeal", "§ 56 Absatz 3", {}),
    ("In Satz 2 werden die Wörter „bis dahin“ gestrichen.", "§ 5 Absatz 1", "strike", "§ 5 Absatz 1 Satz 2", {"old": "bis dahin"}),
    ("Absatz 4 wird Absatz 3.", "§ 10", "renumber", "§ 10 Absatz 4", {}),
    ("Der bisherige Wortlaut wird Absatz 1.", "§ 5", "text_to_para", "§ 5", {"label": "1"}),
    ("Die Fußnote 3 wird aufgehoben.", "§ 5", "repeal_footnote", "§ 5", {"labels": ("3",)}),
    ("In der Inhaltsübersicht wird nach der Angabe zu § 28 folgende Angabe eingefügt: „§ 28a Neues“.", "", "insert_unit", "Inhaltsübersicht § 28", {"text": "§ 28a Neues"}),
    ("Nach der Angabe zu § 9 wird folgende Angabe eingefügt: „§ 9a Neues“.", "Inhaltsübersicht", "insert_unit", "Inhaltsübersicht § 9", {}),
    ("Die Inhaltsübersicht wird entsprechend angepasst.", "", "refer", "Inhaltsübersicht", {}),
]


@pytest.mark.parametrize(("text", "context", "kind", "at", "fields"), CASES)
def test_single(text, context, kind, at, fields):
    c = read(text, context)
    assert c is not None and (c.kind, L.show(c.at)) == (kind, at)
    assert {k: getattr(c, k) for k in fields} == fields


COMPOUNDS = [
    ("In § 3 Absatz 1 Satz 2 und Absatz 4 wird jeweils die Angabe „x“ gestrichen.", "", [("strike", "§ 3 Absatz 1 Satz 2"), ("strike", "§ 3 Absatz 4")]),
    ("Die bisherigen Absätze 2 bis 4 werden die Absätze 3 bis 5.", "§ 5", [("renumber", "§ 5 Absatz 4"), ("renumber", "§ 5 Absatz 3"), ("renumber", "§ 5 Absatz 2")]),
    ("Die bisherige Nr. 7 wird Nr. 5 und das Komma wird durch das Wort „und“ ersetzt.", "§ 14", [("renumber", "§ 14 Nummer 7"), ("replace", "§ 14 Nummer 5")]),
    ("Der bisherige Absatz 1 wird Absatz 2 und nach Satz 2 wird folgender Satz eingefügt: „Neu.“", "§ 1", [("renumber", "§ 1 Absatz 1"), ("insert_unit", "§ 1 Absatz 2 Satz 2")]),
    ("In Absatz 1 werden die Wörter „a“ durch die Wörter „b“ und die Wörter „c“ durch die Wörter „d“ ersetzt.", "§ 5", [("replace", "§ 5 Absatz 1")] * 2),
    ("In § 1 wird nach dem Wort „x“ das Wort „y“ eingefügt und das Wort „z“ gestrichen.", "", [("insert_words", "§ 1"), ("strike", "§ 1")]),
    ("§ 3 Absatz 2 und 3 wird aufgehoben.", "", [("repeal", "§ 3 Absatz 3"), ("repeal", "§ 3 Absatz 2")]),
    ("In Nummer 5 wird der Punkt am Ende durch ein Komma ersetzt und folgende Nummer 6 angefügt: „6. neu.“", "§ 4 Absatz 2", [("replace", "§ 4 Absatz 2 Nummer 5"), ("append", "§ 4 Absatz 2")]),
    ("Die §§ 4 bis 6 werden die §§ 5 bis 7.", "", [("renumber", "§ 4"), ("renumber", "§ 5"), ("renumber", "§ 6")]),
]


@pytest.mark.parametrize(("text", "context", "parts"), COMPOUNDS)
def test_compound(text, context, parts):
    c = read(text, context)
    assert c is not None and c.kind == "compound" and [(p.kind, L.show(p.at)) for p in c.parts] == parts


@pytest.mark.parametrize("text", ["Dies ist kein Befehl.", "In Hausnummer 3 wird das Wort „a“ gestrichen.", "§ 3 bleibt unberührt.", "x" * 5000])
def test_nothing_is_guessed(text):
    assert read(text) is None


def test_a_quote_is_never_read_as_a_command():
    c = read("§ 1 wird wie folgt gefasst: „§ 1 In Absatz 2 wird das Wort „a“ gestrichen.“")
    assert c.kind == "redraft"


def test_frames():
    assert frame("§ 8 Absatz 1 wird wie folgt geändert:") == L.parse("§ 8 Absatz 1") and frame("Absatz 3 wird aufgehoben.") is None


MORE = [
    ("Nummer 3 wird durch die folgende Nummer 3 ersetzt: 3. „ die Regeln gelten.“", "§ 1", "redraft", {"text": "3. die Regeln gelten."}),
    ("In Absatz 2 wird Satz 1 wie folgt gefasst: „Neu.“", "§ 5", "redraft", {"at": L.parse("§ 5 Absatz 2 Satz 1")}),
    ("In der Angabe vor Nummer 1 wird die Angabe „1“ durch die Angabe „2“ ersetzt.", "§ 4 Absatz 1", "replace", {"at": L.parse("§ 4 Absatz 1")}),
    ("In Nummer 7 wird das Wort „oder“ am Ende durch ein Komma ersetzt.", "§ 1", "replace", {"at_end": True, "new": ","}),
    ("In Absatz 3 wird vor dem Punkt am Ende ein Komma und werden die Wörter „oder mehr“ eingefügt.", "§ 8", "replace", {"old": ".", "new": ", oder mehr.", "at_end": True}),
    ("Der Nummer 1 wird folgende Nummer 1 vorangestellt: „1. neu,“.", "§ 6", "insert_unit", {"before": True}),
    ("Dem Wortlaut werden die folgenden Absätze 1 und 2 vorangestellt: „(1) A. (2) B.“", "§ 6", "prepend", {"level": L.PARA}),
    ("Die Inhaltsübersicht wird durch die folgende Inhaltsübersicht ersetzt: „Inhaltsübersicht § 1 Neu“.", "", "redraft", {"at": L.parse("Inhaltsübersicht")}),
    ("Die Angaben zu den §§ 3 bis 5 werden durch die folgenden Angaben ersetzt: „§ 3 A“.", "Inhaltsübersicht", "replace_units", {"to": L.parse("Inhaltsübersicht § 5")}),
    ("Die §§ 3 bis 5 werden wie folgt gefasst: „§ 3 A § 4 B § 5 C“", "", "replace_units", {"labels": ("§ 3", "§ 4", "§ 5")}),
    ("Die bisherigen §§ 9 bis 12 werden die §§ 8 bis 10.", "", "renumber_range", {"new_labels": ("8", "9", "10")}),
]


@pytest.mark.parametrize(("text", "context", "kind", "fields"), MORE)
def test_more_forms(text, context, kind, fields):
    c = read(text, context)
    assert c is not None and c.kind == kind and {k: getattr(c, k) for k in fields} == fields


@pytest.mark.parametrize(
    ("text", "last"),
    [
        ("Der bisherige Absatz 8 wird Absatz 9 und in Satz 3 wird die Angabe „a“ durch die Angabe „b“ ersetzt.", "§ 5 Absatz 9 Satz 3"),
        ("Der bisherige Wortlaut wird Absatz 1 und in Satz 2 wird das Wort „a“ gestrichen.", "§ 5 Absatz 1 Satz 2"),
        ("Die bisherige Nummer 1 wird Nummer 2 und in ihr wird das Wort „a“ gestrichen.", "§ 5 Nummer 2"),
        ("Die bisherige Nummer 6 wird Nummer 5 und wird wie folgt geändert: Die Angabe „a“ wird durch die Angabe „b“ ersetzt.", "§ 5 Nummer 5"),
        ("Die bisherige Nummer 3 wird Nummer 4 und wird wie folgt gefasst: 4. „ neu.“", "§ 5 Nummer 4"),
        ("In Satz 2 wird der Punkt durch einen Strichpunkt ersetzt und folgender Halbsatz angefügt: „neu.“", "§ 5 Satz 2"),
        ("In Buchstabe a wird das Wort „a“ durch das Wort „b“ ersetzt, wird dem Wort „c“ das Wort „d“ vorangestellt und wird das Wort „e“ gestrichen.", "§ 5 Buchstabe a"),
    ],
)
def test_a_clause_inherits_its_place(text, last):
    c = read(text, "§ 5")
    assert c is not None and c.kind == "compound" and L.show(c.parts[-1].at) == last


def test_commands_as_a_table(spark):
    from lexloom.plans.commands import commands

    rows = [(1, "In Absatz 1 wird das Wort „a“ durch das Wort „b“ und das Wort „c“ durch das Wort „d“ ersetzt.", "§ 2"), (2, "Kein Befehl.", None), (3, "Nach § 1 wird folgender § 1a eingefügt: „§ 1a Neu“", None), (4, None, None)]
    got = commands(spark.createDataFrame(rows, "id int, text string, place string"), context="place").orderBy("id", "part").collect()
    assert [(r["id"], r["part"], r["kind"], r["at"]) for r in got] == [(1, 0, "replace", "§ 2 Absatz 1"), (1, 1, "replace", "§ 2 Absatz 1"), (2, 0, "unknown", ""), (3, 0, "insert_unit", "§ 1"), (4, 0, "unknown", "")]
    assert got[1]["old"] == "c" and got[3]["label"] == "1a" and got[2]["text"] == "Kein Befehl."


def test_a_rule_that_matches_but_cannot_make_out_its_place_ends_the_search():
    assert recognise("Die Absätze 4 bis 2 werden durch die folgenden Absätze 2 und 3 ersetzt: „(2) A\n(3) B“") is None
