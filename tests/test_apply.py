import pytest

from lexloom.functions import locator as L
from lexloom.plans.apply import apply_all, heal, occurrences, quote_norms
from lexloom.plans.model import APPLIED, MANUAL, Failure
from lexloom.plans.order import steps_in_order
from lexloom.plans.recognise import recognise
from lexloom.sources.canonical import read_law, write_law

LAW = """Gesetz über die Probe
(Probegesetz – ProbG)
Stand: Zuletzt geändert am 3. Mai 2020
Inhaltsübersicht
§ 1 | Zweck
§ 2 | Verfahren
§ 3 | Ende
Abschnitt 1  Allgemeines
§ 1  Zweck
(1) Zweck ist die Probe.
(2) Die Probe umfasst
  1. das Lesen von Gesetzen,
  2. die Anwendung von Befehlen und
    a) deren Prüfung,
    b) deren Druck,
  3. die Ausgabe.
(3) Das Nähere regelt eine Verordnung; sie bedarf der Zustimmung.
§ 2  Verfahren
Die Prüfung ist einfach. Die Prüfung erfolgt sorgfältig.
Abschnitt 2  Schluss
§ 3  Ende
(1) Es endet.
(2) Es endet ganz.
(3) Es endet nie.
"""


def run(*texts, law=LAW):
    commands = [recognise(t) for t in texts]
    assert all(commands), [t for t, c in zip(texts, commands, strict=True) if c is None]
    return apply_all(read_law(law), commands)


def para(law, norm, k):
    return law.norm(norm).paragraphs[k].text


@pytest.mark.parametrize(
    ("text", "norm", "k", "result"),
    [
        ("In § 1 Absatz 1 wird das Wort „Probe“ durch die Wörter „gute Probe“ ersetzt.", "§ 1", 0, "Zweck ist die gute Probe."),
        ("In § 2 wird jeweils das Wort „Prüfung“ durch das Wort „Schau“ ersetzt.", "§ 2", 0, "Die Schau ist einfach. Die Schau erfolgt sorgfältig."),
        ("In § 2 Satz 2 wird das Wort „Prüfung“ durch das Wort „Schau“ ersetzt.", "§ 2", 0, "Die Prüfung ist einfach. Die Schau erfolgt sorgfältig."),
        ("In § 2 Satz 2 wird das Wort „sorgfältig“ gestrichen.", "§ 2", 0, "Die Prüfung ist einfach. Die Prüfung erfolgt."),
        ("In § 1 Absatz 2 Nummer 1 wird nach dem Wort „Lesen“ das Wort „alter“ eingefügt.", "§ 1", 1, "das Lesen alter von Gesetzen,"),
        ("In § 1 Absatz 2 Nummer 3 wird der Punkt durch ein Komma ersetzt.", "§ 1", 1, "  3. die Ausgabe,"),
        ("In § 1 Absatz 2 Nummer 3 wird der Punkt am Ende durch die Wörter „und mehr.“ ersetzt.", "§ 1", 1, "  3. die Ausgabe und mehr."),
        ("In § 1 Absatz 2 Nummer 2 Buchstabe b wird das Komma am Ende durch das Wort „und“ ersetzt.", "§ 1", 1, "    b) deren Druck und"),
        ("§ 3 Absatz 2 wird wie folgt gefasst: „(2) Neu.“", "§ 3", 1, "Neu."),
        ("§ 1 Absatz 2 Nummer 1 wird wie folgt gefasst: „1. das Schreiben,“", "§ 1", 1, "\n  1. das Schreiben,\n  2. die"),
        ("§ 2 Satz 1 wird durch die folgenden Sätze ersetzt: „Eins ist. Zwei ist.“", "§ 2", 0, "Eins ist. Zwei ist. Die Prüfung erfolgt sorgfältig."),
        ("In § 1 Absatz 2 wird nach Nummer 1 folgende Nummer 1a eingefügt: „1a. das Zählen,“", "§ 1", 1, "Gesetzen,\n  1a. das Zählen,\n  2. die"),
        ("Dem § 1 Absatz 2 wird folgende Nummer 4 angefügt: „4. der Rest.“", "§ 1", 1, "  3. die Ausgabe.\n  4. der Rest."),
        ("Dem § 3 Absatz 1 wird folgender Satz angefügt: „Wirklich.“", "§ 3", 0, "Es endet. Wirklich."),
        ("In § 2 wird nach Satz 1 folgender Satz eingefügt: „Sie ist kurz.“", "§ 2", 0, "Die Prüfung ist einfach. Sie ist kurz. Die Prüfung erfolgt"),
        ("§ 1 Absatz 2 Nummer 2 Buchstabe a wird aufgehoben.", "§ 1", 1, "    a) (weggefallen)\n    b)"),
        ("§ 1 Absatz 3 Halbsatz 2 wird aufgehoben.", "§ 1", 2, "Das Nähere regelt eine Verordnung."),
        ("§ 3 Absatz 2 wird aufgehoben.", "§ 3", 1, "(weggefallen)"),
        ("In § 1 Absatz 2 wird vor den Wörtern „die Ausgabe“ folgende Nummer 2a eingefügt: „2a. die Weitergabe,“", "§ 1", 1, "  2a. die Weitergabe,\n  3. die Ausgabe."),
    ],
)
def test_one_command(text, norm, k, result):
    new, entries = run(text)
    assert [e.status for e in entries] == [APPLIED], entries
    assert result in para(new, norm, k)
    assert read_law(write_law(new)) == new


def test_the_last_item_is_removed_without_a_placeholder():
    new, _ = run("§ 1 Absatz 2 Nummer 3 wird aufgehoben.")
    assert para(new, "§ 1", 1).endswith("b) deren Druck,")


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("In § 2 wird das Wort „Prüfung“ gestrichen.", "AMBIGUOUS"),
        ("In § 1 Absatz 1 wird das Wort „fehlt“ gestrichen.", "TARGET_MISSING"),
        ("In § 1 Absatz 1 wird das Wort „Prob“ gestrichen.", "TARGET_MISSING"),
        ("§ 9 wird aufgehoben.", "STATE_CONFLICT"),
        ("§ 1 Absatz 9 wird aufgehoben.", "PLACE_NOT_FOUND"),
        ("Nach § 1 wird folgender § 2 eingefügt: „§ 2 Doppelt“", "STATE_CONFLICT"),
        ("§ 1 wird durch die folgenden §§ 1 und 1a ersetzt: „ohne Kopf“", "BAD_QUOTE"),
        ("§ 3 Absatz 3 wird Absatz 1.", "STATE_CONFLICT"),
        ("Die Absätze 3 bis 2 werden durch die folgenden Absätze 2 und 3 ersetzt: „(2) A.“", None),
        ("In § 3 wird nach Halbsatz 1 folgender Halbsatz eingefügt: „neu“", "UNSUPPORTED"),
        ("Dem § 3 Absatz 1 wird folgender Halbsatz angefügt: „neu“", "STATE_CONFLICT"),
    ],
)
def test_failures_say_why_and_change_nothing(text, reason):
    if recognise(text) is None:
        assert reason is None
        return
    new, entries = run(text)
    assert entries[0].status == MANUAL and entries[0].reason == reason and entries[0].prose
    assert new == read_law(LAW)


def test_norms_are_inserted_redrafted_and_repealed():
    new, entries = run(
        "Nach § 2 wird folgender § 2a eingefügt: „§ 2a Neues (1) Eins. (2) Zwei.“",
        "§ 3 wird aufgehoben.",
        "§ 1 wird wie folgt gefasst: „§ 1 Ziel\nDas Ziel ist klar.“",
        "Die Inhaltsübersicht wird entsprechend angepasst.",
    )
    assert [e.status for e in entries] == [APPLIED] * 4
    assert [n.label for n in new.norms] == ["Inhaltsübersicht", "§ 1", "§ 2", "§ 2a", "§ 3"]
    assert new.norm("§ 2a").paragraphs[1].whole() == "(2) Zwei." and new.norm("§ 2a").division == 0
    assert new.norm("§ 3").repealed and new.norm("§ 1").title == "Ziel"
    assert para(new, "Inhaltsübersicht", 0).split("\n")[:3] == ["§ 1 | Ziel", "§ 2 | Verfahren", "§ 2a | Neues"]


def test_table_of_contents():
    new, entries = run("In der Inhaltsübersicht wird nach der Angabe zu § 2 folgende Angabe eingefügt: „§ 2a Neues“.", "In der Inhaltsübersicht wird die Angabe zu § 3 gestrichen.")
    assert [e.status for e in entries] == [APPLIED] * 2
    assert para(new, "Inhaltsübersicht", 0) == "§ 1 | Zweck\n§ 2 | Verfahren\n§ 2a | Neues"


def test_divisions():
    new, entries = run("Die Überschrift des Abschnitts 2 wird wie folgt gefasst: „Abschnitt 2 Finale“.")
    assert entries[0].status == APPLIED and new.divisions[1].title == "Finale"


def test_renumbering_comes_before_what_takes_the_label():
    new, entries = run("Nach § 3 Absatz 1 wird folgender Absatz 2 eingefügt: „(2) Neu.“", "Der bisherige § 3 Absatz 2 wird Absatz 3.", "Der bisherige § 3 Absatz 3 wird Absatz 4.")
    assert [e.status for e in entries] == [APPLIED] * 3, entries
    assert [p.whole() for p in new.norm("§ 3").paragraphs] == ["(1) Es endet.", "(2) Neu.", "(3) Es endet ganz.", "(4) Es endet nie."]


def test_order_is_by_dependency_and_a_cycle_stays_as_written():
    order = lambda *t: [str(s.command) for s in steps_in_order([recognise(x) for x in t])]
    assert order("§ 1 Absatz 1 wird Absatz 2.", "§ 9 wird aufgehoben.", "§ 1 Absatz 2 wird Absatz 3.") == ["renumber § 1 Absatz 2", "renumber § 1 Absatz 1", "repeal § 9"]
    cycle = order("§ 1 Absatz 1 wird Absatz 2.", "§ 1 Absatz 2 wird Absatz 1.")
    assert sorted(cycle) == ["renumber § 1 Absatz 1", "renumber § 1 Absatz 2"]


def test_a_renumbering_range_means_the_units_that_exist():
    law = LAW.replace("(2) Es endet ganz.\n", "")
    new, entries = run("§ 3 Absatz 1 bis 3 wird Absatz 4 und 5.", law=law) if recognise("§ 3 Absatz 1 bis 3 wird Absatz 4 und 5.") else (None, None)
    assert entries is None or [p.number for p in new.norm("§ 3").paragraphs] == ["4", "5"]


def test_parts_that_applied_stay_and_the_compound_is_manual():
    new, entries = run("In § 1 Absatz 1 wird das Wort „Zweck“ durch das Wort „Ziel“ und das Wort „fehlt“ durch das Wort „da“ ersetzt.")
    assert entries[0].status == MANUAL and entries[0].reason == "TARGET_MISSING" and para(new, "§ 1", 0) == "Ziel ist die Probe."


def test_an_unfinished_text_keeps_its_items():
    new, entries = run("§ 1 Absatz 2 wird wie folgt gefasst: „(2) Die neue Probe umfasst:“")
    assert entries[0].status == APPLIED and para(new, "§ 1", 1).startswith("Die neue Probe umfasst:\n  1. das Lesen")


def test_words_and_seams():
    assert occurrences("Kunde und und ²und", "und") == [6, 10, 15]
    assert heal("ein ", ", zwei") == "ein, zwei" and heal("ein ", " zwei") == "ein zwei"
    with pytest.raises(Failure):
        quote_norms("kein Kopf")


def test_official_sentence_numbers():
    law = "Gesetz\n§ 1  A\n(1) ¹Eins ist. ²Zwei ist.\n(2) Nur einer."
    new, entries = run("§ 1 Absatz 2 wird wie folgt gefasst: „(2) Drei ist. Vier ist.“", "In § 1 Absatz 1 Satz 2 wird das Wort „Zwei“ durch das Wort „Mehr“ ersetzt.", law=law)
    assert [e.status for e in entries] == [APPLIED] * 2
    assert [p.text for p in new.norm("§ 1").paragraphs] == ["¹Eins ist. ²Mehr ist.", "¹Drei ist. ²Vier ist."]


def test_locators_without_a_norm_fail():
    _, entries = apply_all(read_law(LAW), [recognise("Absatz 3 wird aufgehoben.")])
    assert entries[0].reason == "PLACE_NOT_FOUND" and L.show(entries[0].command.at) == "Absatz 3"


def test_a_reference_follows_the_cited_point_and_says_what_it_cannot():
    from lexloom.plans.compile import compile_act

    act = "Artikel 1\nDas Probegesetz wird wie folgt geändert:\n1. Die Inhaltsübersicht wird entsprechend der {} geändert.\n2. Die Überschrift des § 1 wird wie folgt gefasst: „§ 1 Ziel“.\n3. In § 2 Satz 2 wird das Wort „sorgfältig“ gestrichen.\n"
    law = read_law(LAW)
    new, entries = apply_all(law, compile_act(act.format("Nummer 2"), law).commands)
    assert [e.status for e in entries] == [APPLIED] * 3, [e.prose for e in entries]
    assert para(new, "Inhaltsübersicht", 0).startswith("§ 1 | Ziel\n")
    for point, reason in (("Nummer 3", "UNSUPPORTED"), ("Nummer 9", "PLACE_NOT_FOUND")):
        assert apply_all(law, compile_act(act.format(point), law).commands)[1][0].reason == reason


def test_division_headings_are_inserted_and_replaced():
    new, entries = run("Nach § 2 werden die folgenden Überschriften zu Teil 3 und zu Teil 3 Abschnitt 1 eingefügt: „Teil 3 Neues Abschnitt 1 Grundsätze“.")
    assert entries[0].status == APPLIED, entries
    assert [d.label for d in new.divisions] == ["Abschnitt 1", "Teil 3", "Abschnitt 1", "Abschnitt 2"]
    new, entries = run("Die bisherigen Überschriften zu Abschnitt 2 werden durch die folgende Überschrift zu Teil 2 ersetzt: „Teil 2 Schluss jetzt“.")
    assert entries[0].status == APPLIED and new.divisions[1].label == "Teil 2" and new.divisions[new.norm("§ 3").division].title == "Schluss jetzt"


def test_a_companion_stays_in_its_place_when_its_renumbering_moves_ahead():
    law = "Gesetz\n§ 1  A\n(1) Es umfasst\n  1. die rasche Anmeldung,\n  2. die Prüfung und\n  3. die rasche Bestätigung."
    new, entries = run(
        "§ 1 Absatz 1 Nummer 2 wird Nummer 3.",
        "In § 1 Absatz 1 werden die Wörter „die rasche Anmeldung“ durch die Wörter „die Anmeldung“ ersetzt.",
        "Die bisherige § 1 Absatz 1 Nummer 3 wird Nummer 4 und das Wort „rasche“ wird gestrichen.",
        law=law,
    )
    assert [e.status for e in entries] == [APPLIED] * 3, [e.prose for e in entries]
    assert para(new, "§ 1", 0) == "Es umfasst\n  1. die Anmeldung,\n  3. die Prüfung und\n  4. die Bestätigung."


def test_a_whole_list_goes_without_placeholders_and_ranges_skip_what_is_repealed():
    new, _ = run("§ 1 Absatz 2 Nummer 1 bis 3 wird aufgehoben.")
    assert para(new, "§ 1", 1) == "Die Probe umfasst"
    law = "Gesetz\n§ 1  A\nEins.\n§ 2  B\nZwei.\n§ 3  (weggefallen)\n§ 4  C\nVier."
    new, entries = run("Die bisherigen §§ 2 bis 4 werden die §§ 2 und 3.", law=law)
    assert entries[0].status == APPLIED, entries
    assert [(n.label, n.title) for n in new.norms] == [("§ 1", "A"), ("§ 2", "B"), ("§ 3", "C")]
    assert run("Die bisherigen §§ 1 bis 4 werden die §§ 1 und 2.", law=law)[1][0].reason == "BAD_RANGE"


def test_footnotes_and_sentence_numbers():
    law = "Gesetz\nArt. 1  A\n(1) ¹Die Probe⁶) ist Zweck. ²Sie ist kurz.\n⁶) Anmerkung\n(2) ¹Eins ist. ²Zwei ist.\nArt. 2  B\nOhne Nummer; sie endet."
    new, entries = run("In Art. 1 wird die Fußnote 6 aufgehoben.", "In Art. 1 Abs. 2 Satz 1 wird die Satznummerierung „1“ gestrichen.", "Dem Art. 2 werden die folgenden Abs. 1 und 2 vorangestellt: „(1) A. (2) B.“", law=law)
    assert [e.status for e in entries] == [APPLIED] * 3, [e.prose for e in entries]
    assert para(new, "Art. 1", 0) == "¹Die Probe ist Zweck. ²Sie ist kurz." and para(new, "Art. 1", 1).startswith("Eins ist.")
    assert [p.number for p in new.norm("Art. 2").paragraphs] == ["1", "2", None]
    assert run("In Art. 1 wird die Fußnote 7 aufgehoben.", law=law)[1][0].reason == "TARGET_MISSING"
    new, entries = run("In Art. 2 Halbsatz 2 wird das Wort „endet“ durch das Wort „schließt“ ersetzt.", "Art. 1 Abs. 2 Satz 2 wird Satz 3.", law=law)
    assert para(new, "Art. 2", 0) == "Ohne Nummer; sie schließt." and para(new, "Art. 1", 1) == "¹Eins ist. ³Zwei ist."


def test_headings_of_items_and_placeholders_that_give_way():
    law = "Gesetz\n§ 1  A\n(1) Es gilt\n  1. Kopf der Dinge\n    a) Kopf und Fuß,\n  2. anderes,\n  3. (weggefallen)\n  4. Ende."
    new, entries = run("In der Überschrift des § 1 Absatz 1 Nummer 1 wird das Wort „Kopf“ durch das Wort „Haupt“ ersetzt.", "In § 1 Absatz 1 wird nach Nummer 2 folgende Nummer 3 eingefügt: „3. neu,“", law=law)
    assert [e.status for e in entries] == [APPLIED] * 2, [e.prose for e in entries]
    assert para(new, "§ 1", 0) == "Es gilt\n  1. Haupt der Dinge\n    a) Kopf und Fuß,\n  2. anderes,\n  3. neu,\n  4. Ende."
    assert run("In der Überschrift des § 1 Absatz 1 Nummer 2 wird das Wort „anderes“ gestrichen.", law=law)[1][0].reason == "PLACE_NOT_FOUND"


def test_an_item_is_appended_to_its_list_and_not_behind_what_follows():
    law = "Gesetz\n§ 1  A\n(1) Aufgaben sind\n1. a,\n2. b.\nDies gilt auch sonst."
    new, entries = run("In § 1 Absatz 1 Nummer 2 wird der Punkt am Ende durch ein Semikolon ersetzt.", "Dem § 1 Absatz 1 wird folgende Nummer 3 angefügt: „3. c.“", law=law)
    assert [e.status for e in entries] == [APPLIED] * 2 and para(new, "§ 1", 0) == "Aufgaben sind\n  1. a,\n  2. b;\n  3. c.\nDies gilt auch sonst."
