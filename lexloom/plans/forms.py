"""Forms of amendment prose with what they mean: every rule of the recogniser and every patch operator, held against tables.

A form is prose with placeholders that a row of a table fills: {n}, {p}, {q}, {r} are labels, {a} and {b} words.  ``RECOGNISED`` gives
the commands that the prose stands for, ``APPLIED`` how a law's text changes.  Both are written down here by hand; the queries run the engine, and
the SQL only fills the placeholders of what is written down.
"""

from __future__ import annotations

#: Fields of a command that a form states; those that it leaves out are null, or false.
FIELDS = ("kind", "at", "target", "old", "new", "text", "label", "level", "anchor", "words")
FLAGS = ("each", "at_end", "before")


def _c(kind: str, at: str, **fields) -> dict:
    return {"kind": kind, "at": at} | fields


_TOC = "Inhaltsübersicht"

#: (rule, context, prose, commands)
RECOGNISED: list[tuple[str, str, str, list[dict]]] = [
    ("toc follows", "", "Die Inhaltsübersicht wird entsprechend angepasst.", [_c("refer", _TOC)]),
    ("toc follows a point", "", "Die Inhaltsübersicht wird entsprechend der Nummer {p} geändert.", [_c("refer", _TOC, text="{p}.")]),
    ("toc entry redrafted", "", "In der Inhaltsübersicht wird die Angabe zu § {n} wie folgt gefasst: „§ {n} {a}“.", [_c("redraft", f"{_TOC} § {{n}}", text="§ {n} {a}")]),
    ("toc redrafted", "", "Die Inhaltsübersicht wird durch die folgende Inhaltsübersicht ersetzt: „§ 1 {a}“.", [_c("redraft", _TOC, text="§ 1 {a}")]),
    ("toc entry struck", "", "In der Inhaltsübersicht wird die Angabe zu § {n} gestrichen.", [_c("repeal", f"{_TOC} § {{n}}")]),
    ("toc entry inserted", "", "In der Inhaltsübersicht wird nach der Angabe zu § {n} folgende Angabe eingefügt: „§ {n}a {a}“.", [_c("insert_unit", f"{_TOC} § {{n}}", text="§ {n}a {a}", level="norm")]),
    ("norms redrafted", "", "§ {n} und § {n}a werden wie folgt gefasst: „§ {n} {a} § {n}a {b}“", [_c("replace_units", "§ {n}", target="§ {n}a", text="§ {n} {a} § {n}a {b}", level="norm")]),
    ("redraft with place", "", "In § {n} wird Absatz {p} wie folgt gefasst: „({p}) {a} gilt.“", [_c("redraft", "§ {n} Absatz {p}", text="({p}) {a} gilt.")]),
    ("redraft", "", "§ {n} Absatz {p} erhält folgende Fassung: „({p}) {a} gilt.“", [_c("redraft", "§ {n} Absatz {p}", text="({p}) {a} gilt.")]),
    ("redraft in context", "§ {n}", "Satz {p} wird wie folgt gefasst: „{a} gilt.“", [_c("redraft", "§ {n} Satz {p}", text="{a} gilt.")]),
    ("wording becomes paragraph", "§ {n}", "Der bisherige Wortlaut wird Absatz 1.", [_c("text_to_para", "§ {n}", label="1")]),
    ("wording becomes sentence", "§ {n} Absatz {p}", "Der Wortlaut wird Satz 1.", [_c("text_to_sentence", "§ {n} Absatz {p}", label="1")]),
    ("footnote repealed", "§ {n}", "Die Fußnote {p} wird aufgehoben.", [_c("repeal_footnote", "§ {n}")]),
    ("sentence number struck", "", "In Art. {n} Abs. {p} Satz 1 wird die Satznummerierung „1“ gestrichen.", [_c("strike_sentence_number", "Art. {n} Absatz {p} Satz 1", label="1")]),
    ("heading redrafted", "", "Die Überschrift des § {n} wird wie folgt gefasst: „§ {n} {a}“.", [_c("redraft", "Überschrift § {n}", text="§ {n} {a}")]),
    ("heading replaced", "§ {n}", "Die Überschrift wird durch die folgende Überschrift ersetzt: „§ {n} {a}“.", [_c("redraft", "§ {n} Überschrift", text="§ {n} {a}")]),
    ("one unit becomes several", "", "§ {n} Absatz {p} wird durch die folgenden Absätze {p} und {q} ersetzt: „({p}) {a}. ({q}) {b}.“", [_c("replace_units", "§ {n} Absatz {p}", text="({p}) {a}. ({q}) {b}.", level="para")]),
    ("unit replaced by one", "", "§ {n} wird durch den folgenden § {n} ersetzt: „§ {n} {a}.“", [_c("redraft", "§ {n}", text="§ {n} {a}.")]),
    ("word becomes mark", "§ {n}", "In Nummer {p} wird das Wort „{a}“ am Ende durch ein Komma ersetzt.", [_c("replace", "§ {n} Nummer {p}", old="{a}", new=",", at_end=True)]),
    ("mark becomes comma and words", "§ {n}", "In Satz {p} wird der Punkt am Ende durch ein Komma und die Wörter „sowie {a}“ ersetzt.", [_c("replace", "§ {n} Satz {p}", old=".", new=", sowie {a}", at_end=True)]),
    ("words replaced", "", "In § {n} Absatz {p} werden die Wörter „{a}“ durch die Wörter „{b}“ ersetzt.", [_c("replace", "§ {n} Absatz {p}", old="{a}", new="{b}")]),
    ("words replaced each time", "", "In § {n} wird jeweils die Angabe „{a}“ durch die Angabe „{b}“ ersetzt.", [_c("replace", "§ {n}", old="{a}", new="{b}", each=True)]),
    ("words replaced behind an anchor", "", "In § {n} wird nach dem Wort „{b}“ das Wort „{a}“ durch das Wort „neu“ ersetzt.", [_c("replace", "§ {n}", old="{a}", new="neu")]),
    ("words prepended", "", "In § {n} Absatz {p} wird dem Wort „{a}“ das Wort „neu“ vorangestellt.", [_c("insert_words", "§ {n} Absatz {p}", anchor="before", words="{a}", text="neu")]),
    ("mark becomes wording", "§ {n}", "In Nummer {p} wird der Punkt am Ende durch die Wörter „und {a}.“ ersetzt.", [_c("replace", "§ {n} Nummer {p}", old=".", new="und {a}.", at_end=True)]),
    ("words replaced in context", "§ {n}", "Die Angabe „{a}“ wird durch die Angabe „{b}“ ersetzt.", [_c("replace", "§ {n}", old="{a}", new="{b}")]),
    ("mark replaced in context", "§ {n} Nummer {p}", "Der Punkt am Ende wird durch ein Komma ersetzt.", [_c("replace", "§ {n} Nummer {p}", old=".", new=",", at_end=True)]),
    ("mark replaced", "§ {n}", "In Nummer {p} wird das Komma am Ende durch einen Punkt ersetzt.", [_c("replace", "§ {n} Nummer {p}", old=",", new=".", at_end=True)]),
    ("words inserted after", "", "In § {n} werden nach dem Wort „{a}“ die Wörter „und neu“ eingefügt.", [_c("insert_words", "§ {n}", anchor="after", words="{a}", text="und neu")]),
    ("words inserted before", "", "In § {n} Absatz {p} wird vor dem Wort „{a}“ das Wort „neu“ eingefügt.", [_c("insert_words", "§ {n} Absatz {p}", anchor="before", words="{a}", text="neu")]),
    ("words inserted before the comma", "§ {n}", "In Nummer {p} werden vor dem Komma am Ende die Wörter „sowie {a}“ eingefügt.", [_c("insert_words", "§ {n} Nummer {p}", anchor="before_comma", words="", text="sowie {a}")]),
    ("comma inserted", "", "In § {n} wird nach dem Wort „{a}“ ein Komma eingefügt.", [_c("insert_words", "§ {n}", anchor="after", words="{a}", text=",")]),
    ("comma and words inserted", "", "In § {n} werden nach dem Wort „{a}“ ein Komma und die Wörter „neu“ eingefügt.", [_c("insert_words", "§ {n}", anchor="after", words="{a}", text=", neu")]),
    ("anchor first", "§ {n}", "Nach dem Wort „{a}“ wird das Wort „neu“ eingefügt.", [_c("insert_words", "§ {n}", anchor="after", words="{a}", text="neu")]),
    ("unit inserted at words", "§ {n}", "Vor den Wörtern „{a}“ wird folgender Absatz {p} eingefügt: „({p}) Neu.“", [_c("insert_unit", "§ {n}", anchor="before", words="{a}", label="{p}", level="para", before=True, text="({p}) Neu.")]),
    ("norm inserted", "", "Nach § {n} wird folgender § {n}a eingefügt: „§ {n}a {a}“", [_c("insert_unit", "§ {n}", label="{n}a", level="norm", text="§ {n}a {a}")]),
    ("unit inserted with place", "", "In § {n} wird nach Absatz {p} folgender Absatz {p}a eingefügt: „({p}a) {a}.“", [_c("insert_unit", "§ {n} Absatz {p}", label="{p}a", level="para", text="({p}a) {a}.")]),
    ("sentence inserted", "§ {n} Absatz {p}", "Nach Satz 1 wird folgender Satz eingefügt: „{a}.“", [_c("insert_unit", "§ {n} Absatz {p} Satz 1", level="sentence", text="{a}.")]),
    ("unit prepended", "", "Dem § {n} wird folgender Absatz 1 vorangestellt: „(1) {a}.“", [_c("prepend", "§ {n}", label="1", level="para", text="(1) {a}.")]),
    ("item prepended", "§ {n}", "Der Nummer 1 wird folgende Nummer 1 vorangestellt: „1. {a},“.", [_c("insert_unit", "§ {n} Nummer 1", label="1", level="number", before=True, text="1. {a},")]),
    ("unit appended with place", "", "Dem § {n} Absatz {p} wird folgender Satz angefügt: „{a}.“", [_c("append", "§ {n} Absatz {p}", level="sentence", text="{a}.")]),
    ("unit appended", "§ {n}", "Folgender Absatz {p} wird angefügt: „({p}) {a}.“", [_c("append", "§ {n}", label="{p}", level="para", text="({p}) {a}.")]),
    ("comma and words before the full stop", "§ {n}", "In Absatz {p} wird vor dem Punkt am Ende ein Komma und werden die Wörter „oder {a}“ eingefügt.", [_c("replace", "§ {n} Absatz {p}", old=".", new=", oder {a}.", at_end=True)]),
    ("words appended", "§ {n}", "Dem Absatz {p} werden die Wörter „und {a}“ angefügt.", [_c("insert_words", "§ {n} Absatz {p}", anchor="end", words="", text="und {a}")]),
    ("repealed", "", "§ {n} Absatz {p} wird aufgehoben.", [_c("repeal", "§ {n} Absatz {p}")]),
    ("several repealed, from the last", "", "§ {n} Absatz {p} und {q} wird aufgehoben.", [_c("repeal", "§ {n} Absatz {q}"), _c("repeal", "§ {n} Absatz {p}")]),
    ("words struck", "", "In § {n} Absatz {p} werden die Wörter „{a}“ gestrichen.", [_c("strike", "§ {n} Absatz {p}", old="{a}")]),
    ("words struck behind an anchor", "", "In § {n} wird nach dem Wort „{b}“ das Wort „{a}“ gestrichen.", [_c("strike", "§ {n}", old="{a}")]),
    ("words struck in context", "§ {n} Absatz {p}", "Die Wörter „{a}“ werden gestrichen.", [_c("strike", "§ {n} Absatz {p}", old="{a}")]),
    ("several words struck", "", "In § {n} werden die Wörter „{a}“ und „{b}“ gestrichen.", [_c("strike", "§ {n}", old="{a}"), _c("strike", "§ {n}", old="{b}")]),
    ("units struck, from the first", "", "§ {n} Absatz {p} und {q} wird gestrichen.", [_c("repeal", "§ {n} Absatz {p}"), _c("repeal", "§ {n} Absatz {q}")]),
    ("renumbered", "§ {n}", "Absatz {q} wird Absatz {p}.", [_c("renumber", "§ {n} Absatz {q}", target="§ {n} Absatz {p}")]),
    ("renumbered, former", "§ {n}", "Der bisherige Absatz {p} wird Absatz {q}.", [_c("renumber", "§ {n} Absatz {p}", target="§ {n} Absatz {q}")]),
    ("two renumbered, from the last", "§ {n}", "Die bisherigen Absätze {p} und {q} werden die Absätze {q} und {r}.", [_c("renumber", "§ {n} Absatz {q}", target="§ {n} Absatz {r}"), _c("renumber", "§ {n} Absatz {p}", target="§ {n} Absatz {q}")]),
    ("norm renumbered", "", "Der bisherige § {n} wird § {n}a.", [_c("renumber", "§ {n}", target="§ {n}a")]),
    ("unit inserted without an anchor", "§ {n}", "Es wird folgender Absatz {q} eingefügt: „({q}) {a}.“", [_c("insert_unit", "§ {n} Absatz {p}", label="{q}", level="para", text="({q}) {a}.")]),
    ("unit completed", "", "§ {n} Absatz {p} wird um folgenden Satz 2 ergänzt: „{a}.“", [_c("append", "§ {n} Absatz {p}", label="2", level="sentence", text="{a}.")]),
    ("heading struck", "", "Die Überschrift des § {n} wird gestrichen.", [_c("repeal", "Überschrift § {n}")]),
    ("paragraph number struck", "", "In § {n} wird die Absatzbezeichnung „(1)“ gestrichen.", [_c("repeal", "§ {n} Absatz 1 Absatzbezeichnung")]),
    ("norms renumbered", "", "Die §§ {p} und {q} werden die §§ {q} und {r}.", [_c("renumber", "§ {p}", target="§ {q}"), _c("renumber", "§ {q}", target="§ {r}")]),
    ("range renumbered, from the last", "§ {n}", "Die bisherigen Absätze {p} bis {r} werden die Absätze {q} bis {s}.", [_c("renumber", "§ {n} Absatz {r}", target="§ {n} Absatz {s}"), _c("renumber", "§ {n} Absatz {q}", target="§ {n} Absatz {r}"), _c("renumber", "§ {n} Absatz {p}", target="§ {n} Absatz {q}")]),
    ("range of norms redrafted", "", "Die §§ {p} bis {r} werden wie folgt gefasst: „§ {p} {a} § {q} {b} § {r} Ende“", [_c("replace_units", "§ {p}", target="§ {r}", text="§ {p} {a} § {q} {b} § {r} Ende", level="norm")]),
    ("division heading redrafted", "", "Die Überschrift des Abschnitts {p} wird wie folgt gefasst: „Abschnitt {p} {a}“.", [_c("redraft", "Überschrift Abschnitt {p}", text="Abschnitt {p} {a}")]),
    ("division headings inserted", "", "Nach § {n} wird die folgende Überschrift zu Teil {p} eingefügt: „Teil {p} {a}“.", [_c("division_headings", "§ {n}", text="Teil {p} {a}")]),
    ("division headings replaced", "", "Die bisherigen Überschriften zu Abschnitt {p} werden durch die folgende Überschrift zu Teil {q} ersetzt: „Teil {q} {a}“.", [_c("division_headings", "Abschnitt {p}", text="Teil {q} {a}")]),
    ("division renumbered", "", "Der bisherige Abschnitt {p} wird Abschnitt {q}.", [_c("renumber", "Abschnitt {p}", target="Abschnitt {q}")]),
    ("named mark repealed, wording appended", "§ {n}", "In Absatz {p} wird am Textende nach dem Wort „{b}“ das Satzzeichen „Punkt“ aufgehoben und folgendes angefügt: „und {a}.“", [_c("replace", "§ {n} Absatz {p}", old=".", new="und {a}.", at_end=True)]),
    ("an inserted sentence inherits the new label", "§ {n}", "Der bisherige Absatz {p} wird zu Absatz {q} und nach Satz 2 werden die folgenden Sätze eingefügt: „{a}.“", [_c("renumber", "§ {n} Absatz {p}", target="§ {n} Absatz {q}"), _c("insert_unit", "§ {n} Absatz {q} Satz 2", level="sentence", text="{a}.")]),
    ("half sentence repealed", "", "§ {n} Absatz {p} Halbsatz 2 wird aufgehoben.", [_c("repeal", "§ {n} Absatz {p} Halbsatz 2")]),
    ("annex", "", "In der Anlage {p} wird das Wort „{a}“ durch das Wort „{b}“ ersetzt.", [_c("replace", "Anlage {p}", old="{a}", new="{b}")]),
    ("letters", "", "In § {n} Absatz {p} Nummer 2 Buchstabe b Doppelbuchstabe aa wird das Wort „{a}“ gestrichen.", [_c("strike", "§ {n} Absatz {p} Nummer 2 Buchstabe b Buchstabe aa", old="{a}")]),
    ("several places, each", "", "In § {n} Absatz {p} Satz 1 und Absatz {q} wird jeweils das Wort „{a}“ gestrichen.", [_c("strike", "§ {n} Absatz {p} Satz 1", old="{a}"), _c("strike", "§ {n} Absatz {q}", old="{a}")]),
    ("a verb frame's point", "§ {n}", "Absatz {p} wird wie folgt geändert: In Satz 1 wird das Wort „{a}“ gestrichen.", [_c("strike", "§ {n} Absatz {p} Satz 1", old="{a}")]),
    ("pairs replaced", "§ {n}", "In Absatz {p} wird das Wort „{a}“ durch das Wort „eins“ und das Wort „{b}“ durch das Wort „zwei“ ersetzt.", [_c("replace", "§ {n} Absatz {p}", old="{a}", new="eins"), _c("replace", "§ {n} Absatz {p}", old="{b}", new="zwei")]),
    ("pairs inserted", "", "In § {n} werden nach dem Wort „{a}“ das Wort „eins“ und nach dem Wort „{b}“ das Wort „zwei“ eingefügt.", [_c("insert_words", "§ {n}", anchor="after", words="{a}", text="eins"), _c("insert_words", "§ {n}", anchor="after", words="{b}", text="zwei")]),
    ("clauses of different kinds", "", "In § {n} wird nach dem Wort „{a}“ das Wort „neu“ eingefügt und das Wort „{b}“ gestrichen.", [_c("insert_words", "§ {n}", anchor="after", words="{a}", text="neu"), _c("strike", "§ {n}", old="{b}")]),
    ("a clause inherits the new label", "§ {n}", "Der bisherige Absatz {p} wird Absatz {q} und in Satz 1 wird das Wort „{a}“ gestrichen.", [_c("renumber", "§ {n} Absatz {p}", target="§ {n} Absatz {q}"), _c("strike", "§ {n} Absatz {q} Satz 1", old="{a}")]),
    ("a pronoun names the unit", "§ {n}", "Die bisherige Nummer {p} wird Nummer {q} und in ihr wird das Wort „{a}“ gestrichen.", [_c("renumber", "§ {n} Nummer {p}", target="§ {n} Nummer {q}"), _c("strike", "§ {n} Nummer {q}", old="{a}")]),
    ("punctuation of the unit", "§ {n}", "Die bisherige Nummer {p} wird Nummer {q} und das Komma wird durch das Wort „und“ ersetzt.", [_c("renumber", "§ {n} Nummer {p}", target="§ {n} Nummer {q}"), _c("replace", "§ {n} Nummer {q}", old=",", new="und")]),
    ("a mark, then a unit", "", "In § {n} Nummer {p} wird der Punkt am Ende durch ein Komma ersetzt und folgende Nummer {q} angefügt: „{q}. {a}.“", [_c("replace", "§ {n} Nummer {p}", old=".", new=",", at_end=True), _c("append", "§ {n}", label="{q}", level="number", text="{q}. {a}.")]),
    ("nothing is guessed: no command", "", "§ {n} Absatz {p} bleibt unberührt.", [_c("unknown", "", text="§ {n} Absatz {p} bleibt unberührt.")]),
    ("nothing is guessed: no place", "", "In Hausnummer {p} wird das Wort „{a}“ gestrichen.", [_c("unknown", "", text="In Hausnummer {p} wird das Wort „{a}“ gestrichen.")]),
]

#: The law that forms are applied to; {a} and {b} are words of the row.
LAW = """Gesetz über die Probe
(Probegesetz – ProbG)
Inhaltsübersicht
§ 1 | Zweck
§ 2 | Verfahren
§ 3 | Ende
Abschnitt 1  Allgemeines
§ 1  Zweck
(1) Zweck ist die {a}.
(2) Die Probe umfasst
  1. das Lesen von {b},
  2. die Anwendung von Befehlen und
    a) deren Prüfung,
    b) deren Druck,
  3. die Ausgabe.
(3) Das Nähere regelt eine Verordnung; sie bedarf der Zustimmung.
§ 2  Verfahren
Die Prüfung ist {a}. Die Prüfung erfolgt sorgfältig.
Abschnitt 2  Schluss
§ 3  Ende
(1) Es endet.
(2) Es endet ganz.
(3) Es endet nie.
"""
#: The same with Bavarian marks: articles, official sentence numbers, footnotes.
ARTICLES = """Gesetz über die Probe
(Probegesetz – ProbG)
Art. 1  Anfang
(1) ¹Die {a}⁶) ist Zweck. ²Sie ist kurz.
⁶) Anmerkung
(2) ¹Eins ist {b}. ²Zwei ist.
Art. 2  Ende
Ohne Nummer; sie endet.
"""
LAWS = {"law": LAW, "articles": ARTICLES}
#: The mark that a law carries once an act without number and date has been applied.
MARK = ("(Probegesetz – ProbG)\n", "(Probegesetz – ProbG)\nFortgeschrieben durch: Änderungsgesetz (ohne Kennzeichnung)\n")
DONE, BY_HAND = "APPLIED", "MANUAL:"

#: (operator, law, points of the act, what changes in the law's text as (old, new), status of each point with the reason)
APPLIED: list[tuple[str, str, list[str], list[tuple[str, str]], list[str]]] = [
    ("replace", "law", ["In § 1 Absatz 1 wird das Wort „{a}“ durch das Wort „{b}“ ersetzt."], [("ist die {a}.", "ist die {b}.")], [DONE]),
    ("replace each", "law", ["In § 2 wird jeweils das Wort „Prüfung“ durch das Wort „{b}“ ersetzt."], [("Die Prüfung ist", "Die {b} ist"), ("Die Prüfung erfolgt", "Die {b} erfolgt")], [DONE]),
    ("replace at the end", "law", ["In § 1 Absatz 2 Nummer 3 wird der Punkt am Ende durch die Wörter „und {a}.“ ersetzt."], [("die Ausgabe.", "die Ausgabe und {a}.")], [DONE]),
    ("a word becomes a mark", "law", ["In § 1 Absatz 2 Nummer 2 Buchstabe b wird das Komma am Ende durch das Wort „und“ ersetzt."], [("deren Druck,", "deren Druck und")], [DONE]),
    ("no such words", "law", ["In § 1 Absatz 1 wird das Wort „fehlt“ durch das Wort „{b}“ ersetzt."], [], [BY_HAND + "TARGET_MISSING"]),
    ("words within words", "law", ["In § 1 Absatz 2 wird das Wort „Prüf“ durch das Wort „{b}“ ersetzt."], [], [BY_HAND + "TARGET_MISSING"]),
    ("several places", "law", ["In § 2 wird das Wort „Prüfung“ durch das Wort „{b}“ ersetzt."], [], [BY_HAND + "AMBIGUOUS"]),
    ("sentence", "law", ["In § 2 Satz 2 wird das Wort „Prüfung“ durch das Wort „{b}“ ersetzt."], [("Die Prüfung erfolgt", "Die {b} erfolgt")], [DONE]),
    ("strike", "law", ["In § 2 Satz 2 wird das Wort „sorgfältig“ gestrichen."], [("erfolgt sorgfältig.", "erfolgt.")], [DONE]),
    ("strike among several", "law", ["In § 2 wird das Wort „Prüfung“ gestrichen."], [], [BY_HAND + "AMBIGUOUS"]),
    ("insert after words", "law", ["In § 1 Absatz 2 Nummer 1 wird nach dem Wort „Lesen“ das Wort „alter“ eingefügt."], [("das Lesen von", "das Lesen alter von")], [DONE]),
    ("insert before words", "law", ["In § 1 Absatz 1 wird vor dem Wort „Zweck“ das Wort „{b}“ eingefügt."], [("(1) Zweck ist", "(1) {b} Zweck ist")], [DONE]),
    ("insert before the comma", "law", ["In § 1 Absatz 2 Nummer 1 werden vor dem Komma am Ende die Wörter „und {a}“ eingefügt."], [("Lesen von {b},", "Lesen von {b} und {a},")], [DONE]),
    ("insert a comma", "law", ["In § 2 Satz 2 wird nach dem Wort „erfolgt“ ein Komma eingefügt."], [("erfolgt sorgfältig", "erfolgt, sorgfältig")], [DONE]),
    ("append words", "law", ["Dem § 3 Absatz 1 werden die Wörter „und {a}“ angefügt."], [("(1) Es endet.", "(1) Es endet und {a}.")], [DONE]),
    ("one paragraph of a norm", "law", ["In § 3 wird das Wort „ganz“ durch das Wort „{b}“ ersetzt."], [("endet ganz.", "endet {b}.")], [DONE]),
    ("half sentence", "law", ["In § 1 Absatz 3 Halbsatz 2 wird das Wort „Zustimmung“ durch das Wort „{b}“ ersetzt."], [("der Zustimmung.", "der {b}.")], [DONE]),
    ("redraft a paragraph", "law", ["§ 3 Absatz 2 wird wie folgt gefasst: „(2) Neu ist {a}.“"], [("(2) Es endet ganz.", "(2) Neu ist {a}.")], [DONE]),
    ("redraft an item", "law", ["§ 1 Absatz 2 Nummer 1 wird wie folgt gefasst: „1. das Schreiben von {a},“"], [("1. das Lesen von {b},", "1. das Schreiben von {a},")], [DONE]),
    ("redraft a sentence", "law", ["§ 2 Satz 1 wird wie folgt gefasst: „Neu ist {b}.“"], [("Die Prüfung ist {a}.", "Neu ist {b}.")], [DONE]),
    ("redraft that keeps its items", "law", ["§ 1 Absatz 2 wird wie folgt gefasst: „(2) Die neue Probe umfasst:“"], [("(2) Die Probe umfasst\n", "(2) Die neue Probe umfasst:\n")], [DONE]),
    ("redraft a norm", "law", ["§ 2 wird wie folgt gefasst: „§ 2 Verfahren\n(1) Neu ist {a}.\n(2) Alt ist {b}.“"], [("Die Prüfung ist {a}. Die Prüfung erfolgt sorgfältig.", "(1) Neu ist {a}.\n(2) Alt ist {b}.")], [DONE]),
    ("heading", "law", ["Die Überschrift des § 2 wird wie folgt gefasst: „§ 2 Ablauf“."], [("§ 2  Verfahren", "§ 2  Ablauf")], [DONE]),
    ("words of a heading", "law", ["In der Überschrift des § 2 wird das Wort „Verfahren“ durch das Wort „Ablauf“ ersetzt."], [("§ 2  Verfahren", "§ 2  Ablauf")], [DONE]),
    ("one unit becomes several", "law", ["§ 3 Absatz 3 wird durch die folgenden Absätze 3 und 4 ersetzt: „(3) Neu ist {a}.\n(4) Alt ist {b}.“"], [("(3) Es endet nie.", "(3) Neu ist {a}.\n(4) Alt ist {b}.")], [DONE]),
    ("sentences become several", "law", ["§ 2 Satz 1 wird durch die folgenden Sätze ersetzt: „Eins ist {b}. Zwei ist.“"], [("Die Prüfung ist {a}.", "Eins ist {b}. Zwei ist.")], [DONE]),
    ("insert a norm", "law", ["Nach § 2 wird folgender § 2a eingefügt: „§ 2a Neues\nNeu ist {a}.“"], [("erfolgt sorgfältig.\n", "erfolgt sorgfältig.\n§ 2a  Neues\nNeu ist {a}.\n")], [DONE]),
    ("insert a norm that is there", "law", ["Nach § 1 wird folgender § 2 eingefügt: „§ 2 Doppelt\n{a}.“"], [], [BY_HAND + "STATE_CONFLICT"]),
    ("insert a paragraph", "law", ["Nach § 3 Absatz 1 wird folgender Absatz 1a eingefügt: „(1a) Neu ist {a}.“"], [("(1) Es endet.\n", "(1) Es endet.\n(1a) Neu ist {a}.\n")], [DONE]),
    ("insert a sentence", "law", ["In § 2 wird nach Satz 1 folgender Satz eingefügt: „Neu ist {b}.“"], [("ist {a}. Die", "ist {a}. Neu ist {b}. Die")], [DONE]),
    ("insert an item", "law", ["In § 1 Absatz 2 wird nach Nummer 1 folgende Nummer 1a eingefügt: „1a. das Zählen von {a},“"], [("  2. die Anwendung", "  1a. das Zählen von {a},\n  2. die Anwendung")], [DONE]),
    ("insert at words", "law", ["In § 1 Absatz 2 wird vor den Wörtern „die Ausgabe“ folgende Nummer 2a eingefügt: „2a. die Weitergabe,“"], [("  3. die Ausgabe.", "  2a. die Weitergabe,\n  3. die Ausgabe.")], [DONE]),
    ("append a paragraph", "law", ["Dem § 3 wird folgender Absatz 4 angefügt: „(4) Neu ist {a}.“"], [("(3) Es endet nie.", "(3) Es endet nie.\n(4) Neu ist {a}.")], [DONE]),
    ("append a sentence", "law", ["Dem § 3 Absatz 1 wird folgender Satz angefügt: „Neu ist {a}.“"], [("(1) Es endet.", "(1) Es endet. Neu ist {a}.")], [DONE]),
    ("append an item", "law", ["Dem § 1 Absatz 2 wird folgende Nummer 4 angefügt: „4. der {a}.“"], [("  3. die Ausgabe.", "  3. die Ausgabe.\n  4. der {a}.")], [DONE]),
    ("append a norm", "law", ["Folgender § 4 wird angefügt: „§ 4 Neues\nNeu ist {a}.“"], [("(3) Es endet nie.", "(3) Es endet nie.\n§ 4  Neues\nNeu ist {a}.")], [DONE]),
    ("repeal a norm", "law", ["§ 2 wird aufgehoben."], [("§ 2  Verfahren\nDie Prüfung ist {a}. Die Prüfung erfolgt sorgfältig.", "§ 2\n(weggefallen)")], [DONE]),
    ("repeal a paragraph", "law", ["§ 3 Absatz 2 wird aufgehoben."], [("(2) Es endet ganz.", "(2) (weggefallen)")], [DONE]),
    ("repeal the last item", "law", ["§ 1 Absatz 2 Nummer 3 wird aufgehoben."], [("\n  3. die Ausgabe.", "")], [DONE]),
    ("repeal an item before others", "law", ["§ 1 Absatz 2 Nummer 2 Buchstabe a wird aufgehoben."], [("a) deren Prüfung,", "a) (weggefallen)")], [DONE]),
    ("repeal a half sentence", "law", ["§ 1 Absatz 3 Halbsatz 2 wird aufgehoben."], [("Verordnung; sie bedarf der Zustimmung.", "Verordnung.")], [DONE]),
    ("repeal a sentence", "law", ["§ 2 Satz 2 wird aufgehoben."], [(" Die Prüfung erfolgt sorgfältig.", "")], [DONE]),
    ("repeal what is not there", "law", ["§ 1 Absatz 9 wird aufgehoben.", "§ 9 wird aufgehoben."], [], [BY_HAND + "PLACE_NOT_FOUND", BY_HAND + "STATE_CONFLICT"]),
    ("renumber a paragraph", "law", ["§ 3 Absatz 3 wird Absatz 4."], [("(3) Es endet nie.", "(4) Es endet nie.")], [DONE]),
    ("renumber onto another", "law", ["§ 3 Absatz 3 wird Absatz 1."], [], [BY_HAND + "STATE_CONFLICT"]),
    ("renumber an item", "law", ["§ 1 Absatz 2 Nummer 3 wird Nummer 4."], [("  3. die Ausgabe.", "  4. die Ausgabe.")], [DONE]),
    ("a renumbering range", "law", ["§ 3 Absatz 2 wird aufgehoben.", "Die bisherigen §§ 2 und 3 werden die §§ 3 und 4."], [("(2) Es endet ganz.", "(2) (weggefallen)"), ("§ 2  Verfahren", "§ 3  Verfahren"), ("§ 3  Ende", "§ 4  Ende")], [DONE, DONE]),
    ("a frame", "law", ["§ 3 wird wie folgt geändert:\na) In Absatz 1 wird das Wort „endet“ durch das Wort „{b}“ ersetzt.\nb) Absatz 3 wird aufgehoben."], [("(1) Es endet.", "(1) Es {b}."), ("\n(3) Es endet nie.", "\n(3) (weggefallen)")], [DONE, DONE]),
    ("a frame with a command", "law", ["Der bisherige § 3 Absatz 3 wird Absatz 4 und wie folgt geändert:\na) Das Wort „nie“ wird durch das Wort „{b}“ ersetzt."], [("(3) Es endet nie.", "(4) Es endet {b}.")], [DONE, DONE]),
    ("a verb frame", "law", ["Es werden ersetzt:\na) in § 3 Absatz 2 das Wort „ganz“ durch das Wort „{b}“,\nb) in § 3 Absatz 3 das Wort „nie“ durch das Wort „{a}“."], [("endet ganz.", "endet {b}."), ("endet nie.", "endet {a}.")], [DONE, DONE]),
    ("renumber a norm", "law", ["Der bisherige § 3 wird § 4."], [("§ 3  Ende", "§ 4  Ende")], [DONE]),
    ("insert and move", "law", ["Nach § 3 Absatz 1 wird folgender Absatz 2 eingefügt: „(2) Neu ist {a}.“", "Der bisherige § 3 Absatz 2 wird Absatz 3.", "Der bisherige § 3 Absatz 3 wird Absatz 4."], [("(2) Es endet ganz.\n(3) Es endet nie.", "(2) Neu ist {a}.\n(3) Es endet ganz.\n(4) Es endet nie.")], [DONE, DONE, DONE]),
    ("wording becomes a paragraph", "law", ["Der bisherige Wortlaut des § 2 wird Absatz 1."], [("Die Prüfung ist {a}.", "(1) Die Prüfung ist {a}.")], [DONE]),
    ("prepend a paragraph", "law", ["Dem § 2 wird folgender Absatz 1 vorangestellt: „(1) Neu ist {b}.“"], [("Die Prüfung ist {a}.", "(1) Neu ist {b}.\nDie Prüfung ist {a}.")], [DONE]),
    ("compound", "law", ["In § 1 Absatz 1 wird das Wort „Zweck“ durch das Wort „Ziel“ und das Wort „{a}“ durch das Wort „{b}“ ersetzt."], [("Zweck ist die {a}.", "Ziel ist die {b}.")], [DONE]),
    ("compound, in part", "law", ["In § 1 Absatz 1 wird das Wort „Zweck“ durch das Wort „Ziel“ und das Wort „fehlt“ durch das Wort „{b}“ ersetzt."], [("Zweck ist die {a}.", "Ziel ist die {a}.")], [BY_HAND + "TARGET_MISSING"]),
    ("redraft a division's heading", "law", ["Die Überschrift des Abschnitts 2 wird wie folgt gefasst: „Abschnitt 2 Finale“."], [("Abschnitt 2  Schluss", "Abschnitt 2  Finale")], [DONE]),
    ("renumber a division", "law", ["Der bisherige Abschnitt 2 wird Abschnitt 3."], [("Abschnitt 2  Schluss", "Abschnitt 3  Schluss")], [DONE]),
    ("insert division headings", "law", ["Nach § 2 wird die folgende Überschrift zu Teil 3 eingefügt: „Teil 3 Neues“."], [("Abschnitt 2  Schluss\n", "Teil 3  Neues\n"), ("(3) Es endet nie.\n", "(3) Es endet nie.\nAbschnitt 2  Schluss\n")], [DONE]),
    ("replace division headings", "law", ["Die bisherigen Überschriften zu Abschnitt 2 werden durch die folgende Überschrift zu Teil 2 ersetzt: „Teil 2 Finale“."], [("Abschnitt 2  Schluss", "Teil 2  Finale")], [DONE]),
    ("toc entry inserted", "law", ["In der Inhaltsübersicht wird nach der Angabe zu § 2 folgende Angabe eingefügt: „§ 2a Neues“."], [("§ 2 | Verfahren\n", "§ 2 | Verfahren\n§ 2a | Neues\n")], [DONE]),
    ("toc entry struck", "law", ["In der Inhaltsübersicht wird die Angabe zu § 3 gestrichen."], [("§ 3 | Ende\n", "")], [DONE]),
    ("toc entry redrafted", "law", ["In der Inhaltsübersicht wird die Angabe zu § 2 wie folgt gefasst: „§ 2 Ablauf“."], [("§ 2 | Verfahren", "§ 2 | Ablauf")], [DONE]),
    ("toc follows a heading", "law", ["Die Inhaltsübersicht wird entsprechend der Nummer 2 geändert.", "Die Überschrift des § 2 wird wie folgt gefasst: „§ 2 Ablauf“."], [("§ 2 | Verfahren", "§ 2 | Ablauf"), ("§ 2  Verfahren", "§ 2  Ablauf")], [DONE, DONE]),
    ("not a command", "law", ["Hier steht etwas über {a}."], [], [BY_HAND + "NOT_RECOGNISED"]),
    ("footnote", "articles", ["In Art. 1 wird die Fußnote 6 aufgehoben."], [("⁶) ist Zweck", " ist Zweck"), ("\n⁶) Anmerkung", "")], [DONE]),
    ("footnote that is not there", "articles", ["In Art. 1 wird die Fußnote 7 aufgehoben."], [], [BY_HAND + "TARGET_MISSING"]),
    ("sentence number", "articles", ["In Art. 1 Abs. 2 Satz 1 wird die Satznummerierung „1“ gestrichen."], [("(2) ¹Eins", "(2) Eins")], [DONE]),
    ("official sentences", "articles", ["In Art. 1 Abs. 2 Satz 2 wird das Wort „Zwei“ durch das Wort „{a}“ ersetzt."], [("²Zwei ist", "²{a} ist")], [DONE]),
    ("sentences are numbered", "articles", ["Art. 1 Abs. 2 wird wie folgt gefasst: „(2) Drei ist {a}. Vier ist.“"], [("¹Eins ist {b}. ²Zwei ist.", "¹Drei ist {a}. ²Vier ist.")], [DONE]),
    ("renumber a sentence", "articles", ["Art. 1 Abs. 2 Satz 2 wird Satz 3."], [("²Zwei", "³Zwei")], [DONE]),
    ("prepend paragraphs", "articles", ["Dem Art. 2 werden die folgenden Abs. 1 und 2 vorangestellt: „(1) A ist {a}.\n(2) B ist {b}.“"], [("Ohne Nummer;", "(1) A ist {a}.\n(2) B ist {b}.\nOhne Nummer;")], [DONE]),
]


def act(points: list[str]) -> str:
    lines = "\n".join(f"{k}. {p}" for k, p in enumerate(points, 1))
    return f"Artikel 1\nDas Probegesetz wird wie folgt geändert:\n{lines}\n"


def amended(law: str, changes: list[tuple[str, str]], statuses: list[str]) -> str:
    """The law's text as written down: each change once, and the mark of an act that was applied."""
    text = LAWS[law]
    for old, new in [*changes, *([MARK] if DONE in statuses else [])]:
        if text.count(old) != 1:
            raise ValueError(f"{old!r} is there {text.count(old)} times")
        text = text.replace(old, new)
    return text
