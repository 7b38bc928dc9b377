"""What the readers of texts make of given ones: each reader as a function from text to text, with examples that rows of a table fill.

As in ``forms``, {n}, {p}, {q}, {r}, {s} are labels, {a} and {b} words, and what is wanted is written down by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from lexloom.functions import labels
from lexloom.functions import locator as L
from lexloom.functions.sentences import half_sentence_span, numbered, sentence_span, sentences
from lexloom.operators.clean import clean_text
from lexloom.plans import commencement, synopsis
from lexloom.plans.compile import concerns, split_articles
from lexloom.plans.documents import Concordance, committee_text, official_columns, recognise_document
from lexloom.plans.job import run_job
from lexloom.plans.motions import apply_motion
from lexloom.plans.outline import Point, extract_quotes, normal_quotes, restore_quotes, scan_outline
from lexloom.sources.canonical import read_law, write_law
from lexloom.sources.inputs import read_federal_xml


def _parts(text: str) -> list[str]:
    return text.split("\n@\n")


def _cleaned(text: str) -> str:
    return clean_text(text)[0]


def _sentences(text: str) -> str:
    return "|".join(text[a:b] for a, b in sentences(text))


def _span(text: str) -> str:
    body, kind, label = _parts(text)
    found = (sentence_span if kind == "Satz" else half_sentence_span)(body, label)
    return body[slice(*found)] if found else "-"


def _document(text: str) -> str:
    d = recognise_document(text)
    return "|".join([d.kind, d.own_number or "-", ",".join(d.refers_to) or "-", d.title or "-", str(d.issued or "-"), d.name])


def _in_force(text: str) -> str:
    rules, *points = _parts(text)
    read = commencement.read_rules(rules)
    found = [commencement.rule_for(read, *p.split(" @ ")) for p in points]
    return "|".join([str(commencement.staggered(read)), *(str(r.date or "-") if r else "none" for r in found)])


def _outline(text: str) -> str:
    head, points = scan_outline(text)
    out = [head]

    def walk(found: list[Point]) -> None:
        for p in found:
            out.append(f"{' '.join(p.path)}: {p.text}")
            walk(p.children)

    walk(points)
    return "|".join(out)


def _quotes(text: str) -> str:
    found = extract_quotes(normal_quotes(text)[0])
    return "|".join([found.text, *found.quotes, str(len(found.warnings)), restore_quotes(found.text, found.quotes)])


def _locators(text: str) -> str:
    return "|".join(map(L.show, L.parse_many(text))) or "-"


def _labels(text: str) -> str:
    kind, *args = text.split(" ")
    if kind == "follows":
        return str(labels.is_successor(*args))
    if kind == "range":
        return ",".join(labels.expand(*args) or ["-"])
    if kind == "before":
        return labels.predecessor(*args) or "-"
    return ",".join(sorted(args, key=labels.natural))


def _motion(text: str) -> str:
    draft, entries = apply_motion(*_parts(text))
    return "|".join([draft, *(e.status + (f":{e.reason}" if e.reason else "") for e in entries)])


def _law(text: str) -> str:
    return write_law(read_law(text))


def _xml(text: str) -> str:
    return write_law(read_federal_xml(text.encode()))


def _job(text: str) -> str:
    """A job's synopsis, warnings, problems of the table of contents, and how it stands to an official text."""
    base, act, official = (_parts(text) + [None])[:3]
    r = run_job(base, [act], official=official)
    out = [f"{x.label} {x.kind}" for x in synopsis.rows(r.old, r.new, r.entries)] + [f"{a} {b}" for a, b in r.toc_problems]
    if x := r.reconciliation:
        out.append(f"{x.equal} of {x.checked}, missing {','.join(x.missing) or '-'}, extra {','.join(x.extra) or '-'}, deviating {','.join(x.deviating) or '-'}, {x.holds}")
    return "|".join([*out, *(w for w in r.warnings if "Inhaltsübersicht" not in w)])


def _diff(text: str) -> str:
    return "|".join(synopsis.word_diff(*_parts(text)))


def _committee(text: str) -> str:
    return "|".join(official_columns([tuple(x.split(" @ ")) if " @ " in x else (x.rstrip(" @"), "") for x in text.split("\n")]))


def _comparison(text: str) -> str:
    found, warnings = committee_text([tuple(x.split(" @ ")) if " @ " in x else (x, "") for x in text.split("\n")])
    return "|".join([*(found or ["-"]), *warnings])


def _page(text: str) -> str:
    pages, *wordings = _parts(text)
    found = Concordance(list(enumerate(pages.split("\f"), 1)))
    return "|".join(str(found.find(w) or "-") for w in wordings)


def _concerns(text: str) -> str:
    preamble, law = _parts(text)
    return str(concerns(preamble, read_law(law)))


def _articles(text: str) -> str:
    return "|".join(f"{label}={body}" for label, body in split_articles(text))


READERS: dict[str, Callable[[str], str]] = {
    "cleaned_texts": _cleaned, "sentences_of_texts": _sentences, "sentence_places": _span, "numbered_sentences": numbered, "heads_of_documents": _document, "commencements": _in_force,
    "outlines": _outline, "quotes_of_texts": _quotes, "locator_phrases": _locators, "labels_of_units": _labels, "motions_on_drafts": _motion, "laws_as_text": _law,
    "federal_xml": _xml, "jobs_and_their_results": _job, "word_diffs": _diff, "committee_columns": _committee, "committee_comparisons": _comparison, "pages_of_wordings": _page, "preambles": _concerns, "articles_of_acts": _articles,
}

_PROBE = "Gesetz über die Probe\n(Probegesetz – ProbG)\n"
_DRAFT = "Gesetzentwurf\nDrucksache 18/{p}\nEntwurf eines Gesetzes zur Änderung des Probegesetzes\nArtikel 1\nDas Probegesetz wird wie folgt geändert:\n1. § 1 Absatz 1 wird wie folgt gefasst:\n„(1) Vorzulegen sind\n  1. ein alter Plan von {a},\n    a) mit altem Maß,\n    b) mit altem Rand,\n  2. ein alter Bericht. Er ist schriftlich.“\n2. § 2 wird aufgehoben.\nArtikel 2\nInkrafttreten\nDieses Gesetz tritt in Kraft."
_MOVED = "Änderungsantrag\nDrucksache 18/{q}\nzu Drucksache 18/{p}\nDer Landtag wolle beschließen:\n1. "

#: By reader: (text, what it makes of it).
READINGS: dict[str, list[tuple[str, str]]] = {
    "cleaned_texts": [
        ("ein Frauen-\nNr. {p} - Tag der Ausgabe: Erfurt, den {q}. März 2025    12\nhaus für {a}", "ein Frauenhaus für {a}"),
        ("Ein Satz. 14  Gesetz- und Verordnungsblatt für den Freistaat Thüringen\n{b}.", "Ein Satz.\n{b}."),
        ("Ein Satz. Freitag, den {p}. März 2025 31HmbGVBl. Nr. 4 Noch {a}.", "Ein Satz. Noch {a}."),
        ("das Wort „{a}“\nGesetzblatt für Baden-Württemberg, Jahrgang 2025,\nNr. 3 vom {p}. März 2025 Seite 2 von 9\ngestrichen.", "das Wort „{a}“\n\ngestrichen."),
        ("{b}. Nr. 8 Gesetzblatt der Freien Hansestadt Bremen vom {p}. März 2025 44\nText", "{b}.\nText"),
        ("ersetzt: Tag der Ausgabe: Schwerin, den {p}. März 2025 55Nr. 6 „{a}“", "ersetzt: „{a}“"),
        ("Amtsblatt des Saarlandes Teil I vom {p}. März 202577\n{b}", "\n{b}"),
        ("{b} V\norabfassu\nng - wird durch die lekto\nrierte Version ersetzt.\ndann", "{b}\ndann"),
        ("{b}\nSeite {p} von 9\n- {q} -\nDrucksache 17/{n}\nText", "{b}\nText"),
        ("({p}) „ Trotz der {a}", "„({p}) Trotz der {a}"),
        ("§ {n}„\n{a}", "„§ {n}\n{a}"),
        ("{p}. „ ohne {a}“", "„{p}. ohne {a}“"),
        ("ein Kommaeingefügt undwerden durchdie {a}", "ein Komma eingefügt und werden durch die {a}"),
        ("Die Be-\nhörde zahlt Vor- und Nachteile {a}.", "Die Behörde zahlt Vor- und Nachteile {a}."),
        ("nach § {n} a gilt {b}   \n\n\n\nDann", "nach § {n}a gilt {b}\n\nDann"),
        ("das Wort \"{a}\" gilt", "das Wort „{a}“ gilt"),
        ("§ {n} wird wie folgt geändert:a) In Absatz {p}", "§ {n} wird wie folgt geändert:\na) In Absatz {p}"),
        ("u n v e r ä n d e r t und {a}­", "unverändert und {a}"),
    ],
    "sentences_of_texts": [
        ("{a} gilt. Danach gilt {b}.", "{a} gilt.|Danach gilt {b}."),
        ("Nach § {n} Abs. {p} Nr. {q} Buchst. a gilt {a}. Mehr.", "Nach § {n} Abs. {p} Nr. {q} Buchst. a gilt {a}.|Mehr."),
        ("Bis zum {p}. Juni 2020 gilt {a}. Dann nicht.", "Bis zum {p}. Juni 2020 gilt {a}.|Dann nicht."),
        ("Es gilt z. B. Der Rest, insbes. Die Frist, nach Doppelbuchst. Aa. Ende.", "Es gilt z. B. Der Rest, insbes. Die Frist, nach Doppelbuchst. Aa.|Ende."),
        ("Das {p}. Kapitel gilt. {b} folgt.", "Das {p}. Kapitel gilt.|{b} folgt."),
        ("¹{a} ist. ²{b} ist.", "¹{a} ist.|²{b} ist."),
        ("Es umfasst\n  1. {a} und\n  2. {b}. Danach Schluss.", "Es umfasst\n  1. {a} und\n  2. {b}.|Danach Schluss."),
        ("Er sagt „Ja.“ Sie (nein). § {n} gilt.", "Er sagt „Ja.“|Sie (nein).|§ {n} gilt."),
    ],
    "sentence_places": [
        ("{a} ist. {b} ist. Ende.\n@\nSatz\n@\n2", "{b} ist."),
        ("{a} ist. {b} ist. Ende.\n@\nSatz\n@\nletzter", "Ende."),
        ("¹{a} ist. ³{b} ist.\n@\nSatz\n@\n3", "³{b} ist."),
        ("¹{a} ist. ³{b} ist.\n@\nSatz\n@\n2", "-"),
        ("Dies gilt {a}; jenes nicht.\n@\nHalbsatz\n@\n1", "Dies gilt {a};"),
        ("Dies gilt {a}; jenes nicht.\n@\nHalbsatz\n@\n2", "jenes nicht."),
        ("Ohne {a}.\n@\nHalbsatz\n@\n1", "-"),
    ],
    "numbered_sentences": [
        ("{a} ist. {b} ist.", "¹{a} ist. ²{b} ist."),
        ("²{a} ist. {b} ist. Ende.", "¹{a} ist. ²{b} ist. ³Ende."),
        ("Nur {a}.", "Nur {a}."),
        ("Mehr Zeilen\n{a} ist. {b} ist.", "Mehr Zeilen\n{a} ist. {b} ist."),
    ],
    "heads_of_documents": [
        ("Gesetz zur Änderung des Probegesetzes\nVom {p}. Juni 2024\nArtikel 1\nDas Probegesetz wird wie folgt geändert:", "ACT|-|-|Gesetz zur Änderung des Probegesetzes|2024-06-0{p}|Änderungsgesetz vom {p}. Juni 2024"),
        ("Gesetzentwurf\nDrucksache 18/{n}\nEntwurf eines Gesetzes zur Änderung des Probegesetzes\nArtikel 1", "DRAFT|18/{n}|-|Entwurf eines Gesetzes zur Änderung des Probegesetzes|-|Gesetzentwurf Drs. 18/{n}"),
        ("Änderungsantrag\nDrucksache 18/1{n}\nzu Drucksache 18/{n}\nDer Landtag wolle beschließen:", "MOTION|18/1{n}|18/{n}|-|-|Änderungsantrag Drs. 18/1{n}"),
        ("Beschlussempfehlung und Bericht\nDrucksache 18/{n}\nhier: {a} neu\nZusammenstellung", "RECOMMENDATION|18/{n}|-|{a} neu|-|Beschlussempfehlung Drs. 18/{n}"),
        ("Entschließungsantrag\nDrucksache 18/{n}\nDer Landtag wolle beschließen:", "NO_COMMANDS|18/{n}|-|-|-|Dokument Drs. 18/{n}"),
        ("Plenarprotokoll 18/{n}\nEs spricht {a}.", "NO_COMMANDS|-|-|-|-|Dokument (ohne Kennzeichnung)"),
        ("{a}", "UNKNOWN|-|-|-|-|Dokument (ohne Kennzeichnung)"),
    ],
    "commencements": [
        ("Dieses Gesetz tritt am {p}. Juli 2025 in Kraft.\n@\nArtikel 1 @ 1.", "False|2025-07-0{p}"),
        ("(1) Dieses Gesetz tritt vorbehaltlich des Absatzes 2 am 1. Januar 2025 in Kraft.\n(2) Artikel 1 Nummer {p} Buchstabe a tritt am {q}. Juli 2026 in Kraft.\n@\nArtikel 1 @ {p}. a)\n@\nArtikel 1 @ {p}. b)\n@\nArtikel 1 @ {p}. a) aa)", "True|2026-07-0{q}|2025-01-01|2026-07-0{q}"),
        ("Dieses Gesetz tritt am Tag nach der Verkündung in Kraft. Gleichzeitig tritt {a} außer Kraft.\n@\nArtikel 1 @ 1.", "False|-"),
        ("Diese Verordnung tritt am {p}. Juli 2025 außer Kraft.\n@\nArtikel 1 @ 1.", "False|none"),
    ],
    "outlines": [
        ("Kopf {a}\n1. eins\na) zwei {b}\nb) drei\n2. vier", "Kopf {a}|1.: eins|1. a): zwei {b}|1. b): drei|2.: vier"),
        ("1. eins\na) zwei\naa) drei {a}\nbb) vier\nb) fünf\n2. sechs", "|1.: eins|1. a): zwei|1. a) aa): drei {a}|1. a) bb): vier|1. b): fünf|2.: sechs"),
        ("1. a) aa) alles {a}\nbb) mehr\n2. Ende", "|1.: |1. a): |1. a) aa): alles {a}|1. a) bb): mehr|2.: Ende"),
        ("1. eins\n4. kein Punkt {a}\n2. zwei", "|1.: eins\n4. kein Punkt {a}|2.: zwei"),
        ("1. eins\n1a. zwei {b}\n2. drei", "|1.: eins|1a.: zwei {b}|2.: drei"),
    ],
    "quotes_of_texts": [
        ("das Wort „{a}“ durch „{b}“", "das Wort «0» durch «1»|{a}|{b}|0|das Wort „{a}“ durch „{b}“"),
        ("gefasst: „§ {n} „{a}“ gilt“.", "gefasst: «0».|§ {n} „{a}“ gilt|0|gefasst: „§ {n} „{a}“ gilt“."),
        ("das Wort \"{a}\" gilt", "das Wort «0» gilt|{a}|0|das Wort „{a}“ gilt"),
        ("1. gefasst: „{a}\nArtikel 2\nEnde", "1. gefasst: «0»\nArtikel 2\nEnde|{a}|1|1. gefasst: „{a}“\nArtikel 2\nEnde"),
        ("ohne {a}", "ohne {a}|0|ohne {a}"),
    ],
    "locator_phrases": [
        ("§ {n} Absatz {p} Satz 2 Halbsatz 1", "§ {n} Absatz {p} Satz 2 Halbsatz 1"),
        ("§ {n} Abs. {p} Nr. {q} Buchst. b Doppelbuchst. cc", "§ {n} Absatz {p} Nummer {q} Buchstabe b Buchstabe cc"),
        ("§ {n} Absatz {p} und {q}", "§ {n} Absatz {p}|§ {n} Absatz {q}"),
        ("§ {n} Absatz {p} bis {r}", "§ {n} Absatz {p}|§ {n} Absatz {q}|§ {n} Absatz {r}"),
        ("§ {n} Absatz {p} Satz 1 und Absatz {q} Nummer 2", "§ {n} Absatz {p} Satz 1|§ {n} Absatz {q} Nummer 2"),
        ("Art. {n} Abs. {p}", "Art. {n} Absatz {p}"),
        ("der Überschrift des § {n}", "Überschrift § {n}"),
        ("Anlage {p} Nummer {q}", "Anlage {p} Nummer {q}"),
        ("der Inhaltsübersicht", "Inhaltsübersicht"),
        ("Hausnummer {p}", "-"),
        ("§ {n} Absatz {p} {a}", "-"),
    ],
    "labels_of_units": [
        ("follows {p} {q}", "True"), ("follows {p} {r}", "False"), ("follows {p}a {p}b", "True"), ("follows a b", "True"), ("follows bb cc", "True"), ("follows a c", "False"), ("follows ii iii", "True"),
        ("range {p} {s}", "{p},{q},{r},{s}"), ("range {s} {p}", "-"), ("range {n}a {n}c", "{n}a,{n}b,{n}c"), ("before {q}", "{p}"), ("before {n}b", "{n}a"), ("before {n}a", "{n}"), ("before c", "b"),
        ("sorted 10{n} 9 {p}a 10 {p}", "{p},{p}a,9,10,10{n}"),
    ],
    "motions_on_drafts": [
        (_DRAFT + "\n@\n" + _MOVED + "In Artikel 1 Nummer 1 wird in § 1 Absatz 1 Nummer 2 das Wort „alter“ durch das Wort „{b}“ ersetzt.\nBegründung:", _DRAFT.replace("ein alter Bericht", "ein {b} Bericht") + "|APPLIED"),
        (_DRAFT + "\n@\n" + _MOVED + "In Artikel 1 Nummer 1 wird in § 1 Absatz 1 Nummer 1 Buchstabe b das Wort „altem“ durch das Wort „{b}“ ersetzt.\nBegründung:", _DRAFT.replace("mit altem Rand", "mit {b} Rand") + "|APPLIED"),
        (_DRAFT + "\n@\n" + _MOVED + "In Artikel 1 Nummer 1 wird in § 1 Absatz 1 Nummer 9 das Wort „alter“ durch das Wort „{b}“ ersetzt.\nBegründung:", _DRAFT + "|MANUAL:PLACE_NOT_FOUND"),
        (_DRAFT + "\n@\n" + _MOVED + "In Artikel 1 Nummer 1 wird in § 1 Absatz 1 das Wort „altem“ gestrichen.\nBegründung:", _DRAFT.replace("mit altem Maß", "mit Maß").replace("mit altem Rand", "mit Rand") + "|APPLIED"),
        (_DRAFT + "\n@\n" + _MOVED + "Artikel 1 Nummer 2 wird aufgehoben.\nBegründung:", _DRAFT.replace("2. § 2 wird aufgehoben.\n", "") + "|APPLIED"),
        (_DRAFT + "\n@\n" + _MOVED + "In Artikel 1 Nummer 1 wird in § 1 Absatz 1 das Wort „Plan“ durch das Wort „{b}“ und das Wort „fehlt“ durch das Wort „{a}“ ersetzt.\nBegründung:", _DRAFT + "|MANUAL:TARGET_MISSING"),
    ],
    "laws_as_text": [
        (_PROBE + "Stand: {p}. Mai 2020\n§ {n}  Zweck\n(1) {a}\n  1. eins\n    a) zwei\n(2) {b}\n", _PROBE + "Stand: {p}. Mai 2020\n§ {n}  Zweck\n(1) {a}\n  1. eins\n    a) zwei\n(2) {b}\n"),
        (_PROBE + "Abschnitt {p}  {a}\n§ {n}  Zweck\n{b}\nAnlage {p}  Liste\n1. x\n", _PROBE + "Abschnitt {p}  {a}\n§ {n}  Zweck\n{b}\nAnlage {p}  Liste\n  1. x\n"),
        (_PROBE + "§§ {p} und {q} (weggefallen)\n§ {r}  {a}\n{b}\n", _PROBE + "§ {p}\n(weggefallen)\n§ {q}\n(weggefallen)\n§ {r}  {a}\n{b}\n"),
        (_PROBE + "Inhaltsübersicht\n§ {n} | {a}\n§ {n}  {a}\n{b}\n", _PROBE + "Inhaltsübersicht\n§ {n} | {a}\n§ {n}  {a}\n{b}\n"),
        (_PROBE + "Fortgeschrieben durch: Änderungsgesetz vom {p}. Juni 2024\nArt. {n}  {a}\n(1) ¹{a} ist. ²{b} ist.\n", _PROBE + "Fortgeschrieben durch: Änderungsgesetz vom {p}. Juni 2024\nArt. {n}  {a}\n(1) ¹{a} ist. ²{b} ist.\n"),
    ],
    "federal_xml": [
        (
            "<dokumente><norm><metadaten><jurabk>TG</jurabk><langue>Testgesetz</langue><standangabe><standtyp>Stand</standtyp><standkommentar>Geändert {p}.5.2020</standkommentar></standangabe></metadaten></norm>"
            "<norm><metadaten><gliederungseinheit><gliederungskennzahl>010</gliederungskennzahl><gliederungsbez>Abschnitt {p}</gliederungsbez><gliederungstitel>{a}</gliederungstitel></gliederungseinheit></metadaten></norm>"
            "<norm><metadaten><enbez>§ {n}</enbez><titel>Zweck</titel></metadaten><textdaten><text><Content><P>(1) Es gilt<DL><DT>1.</DT><DD><LA>{a} und</LA></DD><DT>2.</DT><DD><LA>zwei<DL><DT>a)</DT><DD><LA>{b}.</LA></DD></DL></LA></DD></DL></P><P>(2) Zeile<BR/>zwei.</P></Content></text></textdaten></norm>"
            "</dokumente>",
            "Testgesetz\n(TG – TG)\nStand: Geändert {p}.5.2020\nAbschnitt {p}  {a}\n§ {n}  Zweck\n(1) Es gilt\n  1. {a} und\n  2. zwei\n    a) {b}.\n(2) Zeile\nzwei.\n",
        ),
        (
            "<dokumente><norm><metadaten><jurabk>TG</jurabk><kurzue>Test</kurzue><langue>Testgesetz</langue></metadaten></norm><norm><metadaten><enbez>§ {n}</enbez><titel>(weggefallen)</titel></metadaten><textdaten><text><Content><P>-</P></Content></text></textdaten></norm>"
            "<norm><metadaten><enbez>Anlage {p}</enbez></metadaten><textdaten><text><Content><P><table><tgroup><tbody><row><entry>{a}</entry><entry>{b}</entry></row></tbody></tgroup></table></P></Content></text></textdaten></norm></dokumente>",
            "Testgesetz\n(Test – TG)\n§ {n}\n-\nAnlage {p}\n{a} | {b}\n",
        ),
    ],
    "jobs_and_their_results": [
        (_PROBE + "§ 1  Zweck\n{a} gilt.\n§ 2  Ende\nEs endet.\n\n@\nArtikel 1\nDas Probegesetz wird wie folgt geändert:\n1. In § 1 wird das Wort „gilt“ durch das Wort „{b}“ ersetzt.\n2. § 2 wird aufgehoben.\n3. Nach § 2 wird folgender § 3 eingefügt: „§ 3 Neu\nText.“", "§ 1 CHANGED|§ 2 REPEALED|§ 3 NEW"),
        (_PROBE + "Inhaltsübersicht\n§ 1 | Zweck\n§ 1  Zweck\n{a} gilt.\n\n@\nArtikel 1\nDas Probegesetz wird wie folgt geändert:\n1. Die Überschrift des § 1 wird wie folgt gefasst: „§ 1 Ziel“.", "§ 1 CHANGED|§ 1 TITLE_DIFFERS"),
        (_PROBE + "§ 1  Zweck\n{a} gilt.\n§ 2  Ende\nEs endet.\n\n@\nArtikel 1\nDas Probegesetz wird wie folgt geändert:\n1. In § 1 wird das Wort „gilt“ durch das Wort „{b}“ ersetzt.\n@\n" + _PROBE + "§ 1  Zweck\n{a} {b}.\n§ 2  Ende\nEs endet nie.\n§ 3  Mehr\n{a}.\n", "§ 1 CHANGED|1 of 3, missing § 3, extra -, deviating § 2, False"),
        (_PROBE + "§ 1  Zweck\n{a} gilt.\n\n@\nArtikel 1\nDas Andere Gesetz wird wie folgt geändert:\n1. § 1 wird aufgehoben.", "Änderungsgesetz (ohne Kennzeichnung) ändert dieses Gesetz nicht."),
        (_PROBE + "Stand: Zuletzt geändert am {p}. Mai 2022\n§ 1  Zweck\n{a} gilt.\n\n@\nArtikel 1\nDas Probegesetz vom {q}. Mai 2019 wird wie folgt geändert:\n1. § 1 wird aufgehoben.", "§ 1 REPEALED|Das Stammgesetz hat den Stand 2022-05-0{p}, Artikel 1 ändert die Fassung vom 2019-05-0{q}."),
    ],
    "word_diffs": [
        ("x {a} y\n@\nx {b} y", "x <del>{a}</del> y|x <ins>{b}</ins> y"),
        ("{a}\n@\n{a}", "{a}|{a}"),
        ("<{p}>\n@\n<{p}> neu", "&lt;{p}&gt;|&lt;{p}&gt;<ins> neu</ins>"),
    ],
    "committee_columns": [
        ("1. {a} links @ unverändert", "1. {a} links"),
        ("1. {a} links @ 1. {b} rechts", "1. {b} rechts"),
        ("1. {a} links @ entfällt\n2. mehr links @ 1. unverändert", "1. mehr links"),
        ("1. {a} links @ unverändert\n{b} weiter @", "1. {a} links|{b} weiter"),
    ],
    "committee_comparisons": [
        ("Beschlussempfehlung\n{b} vorher\nZusammenstellung\nEntwurf @ Beschlüsse des {p}. Ausschusses\n1. {a} links @ unverändert\n2. {b} links @ 2. {a} rechts\nBericht der Abgeordneten\n{b} nachher", "1. {a} links|2. {a} rechts"),
        ("Beschlussempfehlung\n{a} links @ unverändert", "-|Die Beschlussempfehlung enthält keine Zusammenstellung."),
    ],
    "pages_of_wordings": [
        ("Erste Seite mit {a} und Text\fZweite Seite mit {b} und Rest\fDritte ganz andere Seite\n@\nZweite Seite mit {b}\n@\nDritte ganz andere\n@\nkommt nirgends vor\n@\nkurz", "2|3|-|-"),
    ],
    "preambles": [
        ("Das Probegesetz vom {p}. Mai 2019 (GVBl. S. {n}) wird wie folgt geändert:\n@\n" + _PROBE, "True"),
        ("Das Gesetz über die Probe wird wie folgt geändert:\n@\n" + _PROBE, "True"),
        ("Das {a}gesetz wird wie folgt geändert:\n@\n" + _PROBE, "False"),
        ("Das Probegesetz bleibt, wie es ist.\n@\n" + _PROBE, "False"),
        ("Das Gesetz zur Ausführung des Probegesetzes wird wie folgt geändert:\n@\n" + _PROBE, "False"),
    ],
    "articles_of_acts": [
        ("Kopf\nArtikel 1\n{a}\nArtikel 2\n{b}\nBegründung\nText", "Artikel 1={a}|Artikel 2={b}"),
        ("Kopf\n§ {p}\n{a}\n§ {q}\n{b}", "§ {p}={a}|§ {q}={b}"),
        ("Artikel {p} Änderung der {a}\nText", "Artikel {p}=Änderung der {a}\nText"),
    ],
}
