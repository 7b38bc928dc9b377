"""Quotes, outline, acts, commencement, kinds of documents, motions, cleaning, and whole jobs."""

import datetime as dt

import pytest

from lexloom.functions import locator as L
from lexloom.operators.clean import clean_text, is_furniture, join_breaks, reflow, typical_length
from lexloom.plans import commencement, synopsis, toc
from lexloom.plans.compile import compile_act, concerns, split_articles
from lexloom.plans.documents import Concordance, official_columns, recognise_document
from lexloom.plans.job import run_job
from lexloom.plans.motions import apply_motion, draft_for, read_motion
from lexloom.plans.outline import extract_quotes, normal_quotes, restore_quotes, scan_outline
from lexloom.sources.canonical import read_law, write_law

BASE = "Gesetz über die Probe\n(Probegesetz – ProbG)\n§ 1  Zweck\n(1) Zweck ist die Probe.\n(2) Sie ist kurz.\n§ 2  Ende\nEs endet.\n"
ACT = """Gesetz zur Änderung des Probegesetzes
Vom 3. Juni 2024
Artikel 1
Änderung des Probegesetzes
Das Probegesetz vom 1. Mai 2019 (GVBl. S. 42) wird wie folgt geändert:
1. § 1 wird wie folgt geändert:
a) In Absatz 1 wird das Wort „Probe“ durch das Wort „Übung“ ersetzt.
b) Absatz 2 wird aufgehoben.
2. Nach § 2 wird folgender § 3 eingefügt:
„§ 3
Neues
1. Dies ist kein Punkt des Gesetzes.“
3. Hier steht kein Befehl.
Artikel 2
Änderung des Andersgesetzes
Das Andersgesetz wird wie folgt geändert:
1. § 1 wird aufgehoben.
Artikel 3
Inkrafttreten
(1) Dieses Gesetz tritt am 1. Januar 2025 in Kraft.
(2) Abweichend von Absatz 1 tritt Artikel 1 Nummer 2 am 1. Juli 2026 in Kraft.
"""


def test_quotes():
    q = extract_quotes("Das Wort „a „b“ c“ und „d“.")
    assert q.text == "Das Wort «0» und «1»." and q.quotes == ["a „b“ c", "d"] and not q.warnings
    assert restore_quotes(q.text, q.quotes) == "Das Wort „a „b“ c“ und „d“."
    assert extract_quotes("zu viel“").warnings and extract_quotes("„offen").warnings
    q = extract_quotes("„nie geschlossen\nArtikel 2\nRest „x“.")
    assert q.text.startswith("«0»\nArtikel 2") and q.quotes[1] == "x"
    assert normal_quotes('a "b" c')[0] == "a „b“ c" and normal_quotes('„a"')[1]


def test_outline():
    head, points = scan_outline("Kopf\n1. Eins\na) aa\nb) bb\naa) tief\n2. Zwei am\n18. November\n3. Drei")
    assert head == "Kopf" and [p.path for p in points] == [("1.",), ("2.",), ("3.",)]
    assert [p.path for p in points[0].children] == [("1.", "a)"), ("1.", "b)")] and points[0].children[1].children[0].path == ("1.", "b)", "aa)")
    assert "18. November" in points[1].text
    assert [p.path for p in scan_outline("1. a) aa) x\n2. y")[1][0].children[0].children] == [("1.", "a)", "aa)")]


def test_act():
    law = read_law(BASE)
    c = compile_act(ACT, law)
    assert c.articles == ["Artikel 1"]
    assert [(x.kind, L.show(x.at), x.origin.path) for x in c.commands] == [("replace", "§ 1 Absatz 1", "1. a)"), ("repeal", "§ 1 Absatz 2", "1. b)"), ("insert_unit", "§ 2", "2."), ("unknown", "", "3.")]
    assert [label for label, _ in split_articles(ACT)] == ["Artikel 1", "Artikel 2", "Artikel 3"]
    assert concerns("Das ProbG wird wie folgt geändert:", law) and not concerns("Das ProbGX wird wie folgt geändert:", law)
    assert not concerns("Das Gesetz zur Ausführung des Probegesetzes wird wie folgt geändert:", law)
    assert compile_act(ACT, law, "2").articles == ["Artikel 2"]


def test_commencement():
    rules = compile_act(ACT, read_law(BASE)).rules
    assert [r.date for r in rules] == [dt.date(2025, 1, 1), dt.date(2026, 7, 1)] and commencement.staggered(rules)
    assert commencement.rule_for(rules, "Artikel 1", "2. a)").date == dt.date(2026, 7, 1)
    assert commencement.rule_for(rules, "Artikel 1", "1. a)").date == dt.date(2025, 1, 1)
    assert commencement.german_date("31. Februar 2020") is None
    assert commencement.write_date(dt.date(2020, 6, 19)) == "19. Juni 2020"
    assert commencement.read_rules("Dieses Gesetz tritt am Tag nach der Verkündung in Kraft. Gleichzeitig tritt X außer Kraft.")[0].date is None


def test_job():
    r = run_job(BASE, [ACT])
    assert [e.status for e in r.entries] == ["APPLIED"] * 3 + ["MANUAL"]
    assert [n.label for n in r.new.norms] == ["§ 1", "§ 2", "§ 3"] and r.new.norm("§ 1").paragraphs[0].text == "Zweck ist die Übung."
    assert r.new.marks[0].label == "Änderungsgesetz vom 3. Juni 2024"
    assert any("gestaffelt" in w for w in r.warnings)
    later = run_job(BASE, [ACT], as_of=dt.date(2025, 6, 1))
    assert [e.status for e in later.entries] == ["APPLIED", "APPLIED", "NOT_IN_FORCE", "APPLIED"][:3] + ["MANUAL"]
    again = run_job(write_law(r.new), [ACT])
    assert any("schon einmal" in w for w in again.warnings)
    assert read_law(write_law(r.new)) == r.new


def test_synopsis_and_reconciliation():
    r = run_job(BASE, [ACT], official=BASE.replace("Probe.", "Übung.").replace("(2) Sie ist kurz.", "(2) (weggefallen)"))
    assert {x.label: x.kind for x in synopsis.rows(r.old, r.new, r.entries)} == {"§ 1": "CHANGED", "§ 3": "NEW"}
    assert (r.reconciliation.checked, r.reconciliation.equal, r.reconciliation.extra) == (2, 2, ["§ 3"]) and not r.reconciliation.holds
    assert synopsis.word_diff("a b <c>", "a x <c>") == ("a <del>b</del> &lt;c&gt;", "a <ins>x</ins> &lt;c&gt;")
    r.reconciliation.deviating.append("§ 1")
    page = synopsis.render(r.old, r.new, r.entries, r.warnings, True, r.reconciliation, official=r.official)
    assert "Amtlich" in page
    assert "nicht geltendes Recht" in page and "Befehl nicht erkannt (1)" in page and "<ins>" in page
    assert toc.probe(r.old, r.new) == []


def test_documents_are_ordered_and_chained():
    second = ACT.replace("3. Juni 2024", "3. Juni 2023").replace("„Probe“ durch das Wort „Übung“", "„Zweck“ durch das Wort „Ziel“")
    r = run_job(BASE, [ACT, second])
    assert any("geordnet" in w for w in r.warnings) and [d.issued.year for d in r.documents] == [2023, 2024]
    assert r.new.norm("§ 1").paragraphs[0].text == "Ziel ist die Übung."


DRAFT = "Gesetzentwurf\nDrucksache 18/100\nEntwurf eines Gesetzes zur Änderung des Probegesetzes\nArtikel 1\nDas Probegesetz wird wie folgt geändert:\n1. § 1 wird wie folgt gefasst:\n„§ 1 Neues\n(1) Der Antrag ist zu stellen. Er ist schriftlich.\n(2) Ende.“\n2. § 2 wird aufgehoben.\nArtikel 2\nInkrafttreten\nDieses Gesetz tritt in Kraft."
MOTION = "Änderungsantrag\nDrucksache 18/101\nzu Drucksache 18/100\nDer Landtag wolle beschließen:\n1. In Artikel 1 Nummer 1 werden in § 1 Absatz 1 Satz 2 das Wort „schriftlich“ durch die Wörter „in Textform“ ersetzt.\n2. Artikel 1 Nummer 2 wird aufgehoben.\nBegründung:\nText"


def test_motions_change_the_draft():
    text, entries = apply_motion(DRAFT, MOTION)
    assert [e.status for e in entries] == ["APPLIED"] * 2, [e.prose for e in entries]
    assert "Er ist in Textform." in text and "§ 2 wird aufgehoben" not in text and len(read_motion(MOTION)) == 2
    r = run_job(BASE, [DRAFT, MOTION])
    assert [d.own_number for d in r.documents] == ["18/100", "18/101"]
    assert r.draft and r.new.norm("§ 1").paragraphs[0].text.endswith("Er ist in Textform.") and not r.new.norm("§ 2").repealed
    alone = run_job(BASE, [MOTION])
    assert any("zu keinem Entwurf" in w for w in alone.warnings)


def test_kinds():
    assert recognise_document(ACT).kind == "ACT" and recognise_document(ACT).issued == dt.date(2024, 6, 3)
    d, m = recognise_document(DRAFT), recognise_document(MOTION)
    assert (d.kind, d.own_number, m.kind, m.refers_to) == ("DRAFT", "18/100", "MOTION", ("18/100",))
    assert recognise_document("Plenarprotokoll 20/1\nRede").kind == "NO_COMMANDS" and recognise_document("irgendwas").kind == "UNKNOWN"
    assert recognise_document("Gesetz\nVom 1. Mai 2020\nVom 2. Mai 2020").issued is None
    assert draft_for(m, 1, [(0, d), (1, m)]) == 0


def test_committee_columns_and_pages():
    rows = [("1. alt a", "1. unverändert"), ("2. alt b", "2. neu b"), ("weiter b", ""), ("3. alt c", "entfällt"), ("weiter c", ""), ("4. alt d", "3. unverändert"), ("weiter d", "")]
    assert official_columns(rows) == ["1. alt a", "2. neu b", "3. alt d", "weiter d"]
    c = Concordance([(1, "Absatz 3 wird aufge-\nhoben."), (2, "§ 9 Absatz 3 wird aufgehoben.")])
    assert c.find("Absatz 3 wird aufgehoben") == 1 and c.find("§ 9 Absatz 3 wird aufgehoben.") == 2 and c.find("kurz") is None


@pytest.mark.parametrize(
    ("text", "cleaned"),
    [
        ("Die Be-\nhörde gilt.", "Die Behörde gilt."),
        ("Vor- und Nach-\nund Vorteile", "Vor- und Nach-\nund Vorteile"),
        ("Land-\nTag und LandTag", "LandTag und LandTag"),
        ("Nord-\nSüd gilt", "Nord-Süd gilt"),
        ("Text\n- 5 -\nmehr\nSeite 3 von 9\nEnde", "Text\nmehr\nEnde"),
        ("In § 57 c Abs. 1 durchdie Wörter", "In § 57c Abs. 1 durch die Wörter"),
        ("über a²", "über a²"),
        ("Ein „x“und „y“", "Ein „x“ und „y“"),
        ("Satz.\n2397 Bundesgesetzblatt Jahrgang 2020 Teil I Nr. 52, ausgegeben zu Bonn am 18. November 2020\n42\nEnde.", "Satz.\nEnde."),
        ("Satz.\nSeite 2 von 5 Bundesgesetzblatt Jahrgang 2026 Teil I Nr. 43, ausgegeben zu Bonn am 19. Februar 2026\nEnde.", "Satz.\nEnde."),
        ("kurz-\nBayerisches Gesetz- und Verordnungsblatt Nr. 6/202676\nfristig.", "kurzfristig."),
        ("Bayerischer Landtag\n19. Wahlperiode 28.01.2026  Drucksache 19/9707\nA.\nDrucksache 19/9707 Bayerischer Landtag 19. Wahlperiode Seite 2\nB.", "A.\nB."),
        ("A.\nDrucksache 21/61 – 2 – Deutscher Bundestag – 21. Wahlperiode\nDeutscher Bundestag – 21. Wahlperiode – 3 – Drucksache 21/61\nB.", "A.\nB."),
        ("Betrieb\n235Gesetz- und Verordnungsblatt für Berlin      82. Jahrgang      Nr. 17     11. Juni 2026 von Dingen.", "Betrieb\nvon Dingen."),
        ("Satz.\nGesetz- und Verordnungsblatt für Schleswig-Holstein\n2026/27 vom 30. März\nEnde.", "Satz.\nEnde."),
        ("verhält-\n\n\nnismäßig", "verhältnismäßig"),
        ("der Nord-\nKreis-2019", "der Nord-Kreis-2019"),
        ("Bildung und -\nge", "Bildung und -\nge"),
        ("Artikel 1 ¹)\nDas Gesetz", "Artikel 1\nDas Gesetz"),
        ("Artikel 2 ²) Das Gesetz", "Artikel 2\nDas Gesetz"),
        ("a)\u0007 wird ein ge-\nfügt:", "a) wird eingefügt:"),
        ("Art. 28 a Abs. 1 und § 8 c) In und § 5 des", "Art. 28a Abs. 1 und § 8 c) In und § 5 des"),
        ("angefu\u0308gt", "angefügt"),
        ("Erste Zeile wird \ue001\nfortgesetzt. \ue000\nNächste. \ue000", "Erste Zeile wird fortgesetzt.\nNächste."),
        ("Artikel 2\ue001\nInkrafttreten\ue000\nEnde. \ue000", "Artikel 2\nInkrafttreten\nEnde."),
        (None, ""),
        ("", ""),
    ],
)
def test_cleaning(text, cleaned):
    assert clean_text(text)[0] == cleaned


def test_line_breaks():
    assert is_furniture("Drucksache 19/123") and not is_furniture("§ 3 Drucksachen")
    long = "die Verwaltungsangelegen"
    lines = ["x " * 12, long, "heiten der Länder sind ", "y " * 12, "z " * 12, "w " * 12]
    assert join_breaks(lines)[1][0] == "die Verwaltungsangelegenheiten der Länder sind "
    assert join_breaks(lines, ["HARD"] * 6)[1][0] == long
    assert reflow(["Das ist", "ein Satz", "1. neu"], ["SOFT", "SOFT", "UNKNOWN"]) == ["Das ist ein Satz", "1. neu"]
    assert typical_length([10, 20, 0, 30], 1) == 30


def test_verb_frames_and_pages():
    act = "Artikel 1\nDas Probegesetz wird wie folgt geändert:\n1. Es werden ersetzt:\na) in § 1 Absatz 1 die Angabe „Probe“ durch die Angabe „Übung“,\nb) in § 2 die Angabe „endet“ jeweils durch die Angabe „schließt“.\n\f2. In § 1 Absatz 2 wird das Wort „kurz“ durch das Wort „lang“ ersetzt."
    r = run_job(BASE, [act])
    assert [(e.status, L.show(e.command.at), e.command.origin.page) for e in r.entries] == [("APPLIED", "§ 1 Absatz 1", 1), ("APPLIED", "§ 2", 1), ("APPLIED", "§ 1 Absatz 2", 2)], r.entries
    assert str(r.entries[2].command.origin) == "Artikel 1 2. (S. 2)"


def test_the_table_of_contents_is_probed_for_what_changed():
    base = BASE.replace("§ 1  Zweck", "Inhaltsübersicht\n§ 1 | Zweck\n§ 2 | Ende\n§ 1  Zweck")
    r = run_job(base, [ACT + ""])
    assert r.toc_problems == [("§ 3", "NO_ENTRY")] and "§ 3 fehlt in der Inhaltsübersicht." in r.warnings


def test_places_that_a_preamble_sets():
    law = read_law("Landesgesetz\n(LG)\nArt. 7  A\n(1) ¹Eins ist. ²Zwei ist.\n(2) Ohne.\nArt. 28  B\n(1) Eins ist. Zwei ist.\n")
    act = "§ 1\nÄnderung des Landesgesetzes\nDas Landesgesetz (LG), das zuletzt durch\n§ 10 des Gesetzes vom 1. Mai 2020 geändert worden ist, wird wie folgt geändert:\nArt. 28 Abs. 1 wird wie folgt geändert:\n1. Satz 1 wird aufgehoben.\n2. In Satz 1 wird das Wort „Zwei“ durch das Wort „Drei“ ersetzt.\n§ 2\nÄnderung des\nLandesgesetzes\nArt. 7 Abs. 2 des Landesgesetzes (LG) wird wie folgt geändert:\n1. Der Wortlaut wird Satz 1.\n§ 3\nInkrafttreten\nDieses Gesetz tritt am 1. April 2026 in Kraft.\n"
    c = compile_act(act, law)
    assert c.articles == ["§ 1", "§ 2"] and [L.show(x.at) for x in c.commands] == ["Art. 28 Absatz 1 Satz 1", "Art. 28 Absatz 1 Satz 1", "Art. 7 Absatz 2"]
    assert c.rules[0].date == dt.date(2026, 4, 1)
    assert compile_act(act, law, "3").articles == [] and compile_act(act, law, "2").articles == ["§ 2"]
    both = "Artikel 1\nDas Landesgesetz wird wie folgt geändert:\n1. In Art. 28 wird das Wort „Eins“ durch das Wort „Null“ ersetzt.\nArtikel 2\n§ 1\nDieses Gesetz tritt morgen in Kraft.\n"
    assert compile_act(both, law).articles == ["Artikel 1"] and len(compile_act(both, law).commands) == 1


def test_rules_of_commencement():
    at = lambda text, article, path: commencement.rule_for(commencement.read_rules(text), article, path).date
    text = "(1) Dieses Gesetz tritt vorbehaltlich des Absatzes 2 am 27. September 2026 in Kraft.\n(2) Artikel 1 Nummer 2 Buchstabe c tritt am 19. Juni 2026 in Kraft.\nDie Rechte des Bundesrates sind gewahrt."
    assert [at(text, "Artikel 1", x) for x in ("2. c)", "2. d)", "2.")] == [dt.date(2026, 6, 19), dt.date(2026, 9, 27), dt.date(2026, 9, 27)]
    text = "(1) Dieses Gesetz tritt vorbehaltlich des Absatzes 2 am 1. Januar 2024 in Kraft.\n(2) Abweichend von Absatz 1 treten Artikel 1 Nummer 22 sowie Artikel 3 am 1. Oktober 2024 in Kraft. Die Rechte sind gewahrt."
    assert len(commencement.read_rules(text)) == 2
    assert [at(text, a, p) for a, p in (("Artikel 1", "22."), ("Artikel 3", "5. b)"), ("Artikel 1", "21."))] == [dt.date(2024, 10, 1), dt.date(2024, 10, 1), dt.date(2024, 1, 1)]
    text = "(1) Dieses Gesetz tritt vorbehaltlich der Absätze 2 und 3 am Tag nach der Verkündung in Kraft.\n(2) Artikel 4a Nummer 1 tritt mit Wirkung vom\n18. November 2020 in Kraft.\n(3) Artikel 1 Nummer 11 Buchstabe a Doppelbuchstabe bb und Artikel 2 treten am 1. April 2021 in Kraft."
    assert [at(text, a, p) for a, p in (("Artikel 4a", "1."), ("Artikel 1", "11. a) bb)"), ("Artikel 1", "11. a) aa)"), ("Artikel 2", "6. b)"))] == [dt.date(2020, 11, 18), dt.date(2021, 4, 1), None, dt.date(2021, 4, 1)]
    assert commencement.read_rules("Diese Verordnung tritt am 31. Dezember 2027 außer Kraft.") == []


def test_the_closing_article_of_the_own_act_counts():
    law = read_law(BASE)
    act = "Artikel 1\nDas Andersgesetz wird wie folgt geändert:\n1. § 1 wird aufgehoben.\nArtikel 2\nDieses Gesetz tritt am 1. März 2026 in Kraft.\nArtikel 3\nDas Probegesetz wird wie folgt geändert:\n1. § 2 wird aufgehoben.\nArtikel 4\nDieses Gesetz tritt am 1. Juli 2026 in Kraft.\n"
    assert compile_act(act, law).rules[0].date == dt.date(2026, 7, 1)


def test_a_quote_without_an_end_ends_where_that_is_sure():
    q = extract_quotes("Artikel 1\nbb) Vor den Wörtern „Aus dem Bereich:“ wird folgender Absatz 5 eingefügt:\n„(5) Die Kontrolle.\ncc) Absatz 5 wird Absatz 6.\nc) Nummer 31 wird wie folgt gefasst:\n„Nummer 31\nNeu.“\n")
    assert q.quotes == ["Aus dem Bereich:", "(5) Die Kontrolle.", "Nummer 31\nNeu."] and "cc) Absatz 5 wird" in q.text and len(q.warnings) == 1
    balanced = extract_quotes("Artikel 1\n2. § 5 wird wie folgt gefasst:\n„Die Verordnung wird wie folgt geändert:\n1. § 2 wird aufgehoben.“\n")
    assert len(balanced.quotes) == 1 and not balanced.warnings
    deeper = extract_quotes("Artikel 1\n2. § 5 wird wie folgt gefasst:\n„(1) Es gilt:\naa) § 7 wird aufgehoben.\n")
    assert "aa) § 7" in deeper.quotes[0] and len(deeper.warnings) == 1


INNER = "Gesetzentwurf\nDrucksache 18/200\nEntwurf eines Gesetzes zur Änderung des Probegesetzes\nArtikel 1\nDas Probegesetz wird wie folgt geändert:\n1. § 1 Absatz 1 wird wie folgt gefasst:\n„(1) Vorzulegen sind\n  1. ein alter Plan,\n    a) mit altem Maß,\n    b) mit altem Rand,\n  2. ein alter Bericht.“\nArtikel 2\nInkrafttreten\nDieses Gesetz tritt in Kraft."


def _motion(*points):
    lines = "\n".join(f"{k}. {p}" for k, p in enumerate(points, 1))
    return f"Änderungsantrag\nDrucksache 18/201\nzu Drucksache 18/200\nDer Landtag wolle beschließen:\n{lines}\nBegründung:\nText"


def test_motions_change_the_item_that_they_name():
    text, entries = apply_motion(INNER, _motion("In Artikel 1 Nummer 1 wird in § 1 Absatz 1 Nummer 2 das Wort „alter“ durch das Wort „neuer“ ersetzt."))
    assert [e.status for e in entries] == ["APPLIED"] and "1. ein alter Plan" in text and "2. ein neuer Bericht" in text
    text, entries = apply_motion(INNER, _motion("In Artikel 1 Nummer 1 wird in § 1 Absatz 1 Nummer 1 Buchstabe b das Wort „altem“ durch das Wort „neuem“ ersetzt."))
    assert "a) mit altem Maß" in text and "b) mit neuem Rand" in text
    text, entries = apply_motion(INNER, _motion("In Artikel 1 Nummer 1 wird in § 1 Absatz 1 Nummer 4 das Wort „alter“ durch das Wort „neuer“ ersetzt."))
    assert text == INNER and [(e.status, e.reason) for e in entries] == [("MANUAL", "PLACE_NOT_FOUND")]


def test_motions_that_strike_leave_indentation():
    text, entries = apply_motion(INNER, _motion("In Artikel 1 Nummer 1 wird in § 1 Absatz 1 das Wort „altem“ gestrichen."))
    assert [e.status for e in entries] == ["APPLIED"] and "    a) mit Maß,\n    b) mit Rand,\n  2. ein alter Bericht." in text


def test_a_section_of_the_act_may_amend_the_law_where_no_article_does():
    act = "Artikel 1\nDas Andere Gesetz wird wie folgt geändert:\n1. § 9 wird aufgehoben.\n§ 2\nDas Probegesetz wird wie folgt geändert:\n1. § 2 wird aufgehoben."
    assert [str(e.command) for e in run_job(BASE, [act]).entries] == ["repeal § 2"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("ein Frauen-\nNr. 5 - Tag der Ausgabe: Erfurt, den 3. März 2025    12\nhaus dort", "ein Frauenhaus dort"),
        ("Ein Satz. 14  Gesetz- und Verordnungsblatt für den Freistaat Thüringen\nNoch einer.", "Ein Satz.\nNoch einer."),
        ("Ein Satz. Freitag, den 7. März 2025 31HmbGVBl. Nr. 4 Noch einer.", "Ein Satz. Noch einer."),
        ("HmbGVBl. Nr. 4 Freitag, den 7. März 2025 32\nText", "\nText"),
        ("das Wort „alt“\nGesetzblatt für Baden-Württemberg, Jahrgang 2025,\nNr. 3 vom 7. März 2025 Seite 2 von 9\ngestrichen.", "das Wort „alt“\n\ngestrichen."),
        ("Ein Satz. Nr. 8 Gesetzblatt der Freien Hansestadt Bremen vom 7. März 2025 44\nText", "Ein Satz.\nText"),
        ("ersetzt: Tag der Ausgabe: Schwerin, den 7. März 2025 55Nr. 6 „neu“", "ersetzt: „neu“"),
        ("56 Gesetz- und Verordnungsblatt für Mecklenburg-Vorpommern 2025 Nr. 6\nText", "\nText"),
        ("Amtsblatt des Saarlandes Teil I vom 7. März 202577\nText", "\nText"),
        ("ist im Amtsblatt des Saarlandes bekannt zu machen", "ist im Amtsblatt des Saarlandes bekannt zu machen"),
        ("Erst V\norabfassu\nng - wird durch die lekto\nrierte Version ersetzt.\ndann", "Erst\ndann"),
        ("(2) „ Trotz des", "„(2) Trotz des"),
        ("§ 7„\nTitel", "„§ 7\nTitel"),
        ("§ 7„ Titel", "„§ 7 Titel"),
        ("4. „ ohne Rand“", "„4. ohne Rand“"),
        ("4a. „großer Rand“ heißt", "4a. „großer Rand“ heißt"),
        ("Wenn er setzt, gilt", "Wenn er setzt, gilt"),
        ("ein Kommaeingefügt undwerden", "ein Komma eingefügt und werden"),
        ("§ 4 wird wie folgt geändert:a) In Absatz 1", "§ 4 wird wie folgt geändert:\na) In Absatz 1"),
    ],
)
def test_furniture_and_misprints(raw, clean):
    assert clean_text(raw)[0] == clean


def test_synopsis_shows_an_item_that_opens_a_paragraph_right_behind_its_number():
    from lexloom.plans.apply import apply_all
    from lexloom.plans.recognise import recognise
    from lexloom.sources.canonical import read_law

    old = read_law("Gesetz\n(G)\n§ 1  Text\n(1) 94.182.225.142 ist the Wort\n(2) 1. eins\n2. zwei")
    new, entries = apply_all(old, [recognise("In § 1 wird das Wort „the“ durch das Wort „ein“ ersetzt.")])
    (row,) = synopsis.rows(old, new, entries)
    assert row.new_text == "(1) 94.182.225.142 ist ein Wort\n\n(2) 1. eins\n  2. zwei"
