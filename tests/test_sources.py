import io
import zipfile

import pytest

from lexloom.operators.relate import regressions
from lexloom.plans import engine
from lexloom.sources import inputs
from lexloom.sources.canonical import read_law, write_law
from tests.test_documents import ACT, BASE

XML = """<?xml version="1.0"?><dokumente>
<norm><metadaten><jurabk>TG</jurabk><langue>Testgesetz</langue><standangabe><standtyp>Stand</standtyp><standkommentar>Geändert 1.5.2020</standkommentar></standangabe></metadaten></norm>
<norm><metadaten><gliederungseinheit><gliederungskennzahl>010</gliederungskennzahl><gliederungsbez>Abschnitt 1</gliederungsbez><gliederungstitel>Allgemeines</gliederungstitel></gliederungseinheit></metadaten></norm>
<norm><metadaten><enbez>§ 1</enbez><titel>Zweck</titel></metadaten><textdaten><text><Content><P>(1) Es gilt<DL><DT>1.</DT><DD><LA>eins und</LA></DD><DT>2.</DT><DD><LA>zwei<DL><DT>a)</DT><DD><LA>tief.</LA></DD></DL></LA></DD></DL></P><P>(2) Zeile<BR/>zwei.</P></Content></text></textdaten></norm>
<norm><metadaten><enbez>§ 2</enbez><titel>(weggefallen)</titel></metadaten><textdaten><text><Content><P>-</P></Content></text></textdaten></norm>
</dokumente>"""

TEXTS = [
    BASE,
    "Gesetz\nInhaltsübersicht\n§ 1 | Eins\nTeil 1 | Anfang\nTeil 1  Anfang\n§ 1  Eins\nText ohne Nummer.\nTeil 2  Ende\n§ 1a  Zwei\n(1) a\n  1. b\n    a) c\n  2. d\n(2) e\nAnlage 1  Liste\n1. x\n2. y\n",
    "Verordnung\n(Kurz – K)\nStand: heute\nFortgeschrieben durch: Änderungsgesetz vom 3. Juni 2024\nArt. 1  A\n(1) ¹Eins ist. ²Zwei ist.\n§§ 2 und 3 (weggefallen)\n",
]


@pytest.mark.parametrize("text", TEXTS)
def test_what_is_written_is_read_back(text):
    law = read_law(text)
    assert read_law(write_law(law)) == law and law.norms


def test_heads_are_not_citations():
    law = read_law("Gesetz\n§ 1  A\nNach\n§ 5 Absatz 2 gilt dies.\n§ 2  B\n§ 1  Nicht noch einmal\n")
    assert [n.label for n in law.norms] == ["§ 1", "§ 2"]


def test_federal_xml():
    law = inputs.read_law_file(XML.encode())
    assert (law.title, law.abbreviation, law.stand, law.divisions[0].title) == ("Testgesetz", "TG", "Geändert 1.5.2020", "Allgemeines")
    assert law.norm("§ 1").paragraphs[0].whole() == "(1) Es gilt\n  1. eins und\n  2. zwei\n    a) tief." and law.norm("§ 1").paragraphs[1].text == "Zeile\nzwei."
    assert law.norm("§ 2").repealed
    with pytest.raises(ValueError, match="entity"):
        inputs.read_law_file(b'<!DOCTYPE a [<!ENTITY x "y">]><dokumente/>')


def test_archives():
    def pack(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, XML)
        return out.getvalue()

    assert inputs.read_law_file(pack(["a.xml", "__MACOSX/a.xml", "b.jpg"])).title == "Testgesetz"
    with pytest.raises(ValueError, match="2 XML"):
        inputs.unpack(pack(["a.xml", "b.xml"]))
    assert [inputs.sniff(x) for x in (b"PK\x03\x04", b"x%PDF-1", b"\xef\xbb\xbf <a/>", b"Text", b"")] == ["zip", "pdf", "xml", "text", "text"]


def test_jobs_run_in_parallel_and_a_failing_one_is_a_row(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/base.txt").write_text(BASE)
    (tmp_path / "texts/act.txt").write_text(ACT)
    (tmp_path / "jobs.tsv").write_text("# job\tbase\tdocs\tarticle\tofficial\tas_of\neins\tbase.txt\tact.txt\t-\tbase.txt\t-\nzwei\tbase.txt\tact.txt\t-\t-\t2025-06-01\ndrei\tbase.txt\tfehlt.txt\t-\t-\t-\n")
    jobs = inputs.with_texts(spark, inputs.read_job_list(spark, str(tmp_path / "jobs.tsv")), str(tmp_path / "texts"))
    broken = spark.createDataFrame([("vier", None, [], None, None, None, "kaputt")], jobs.schema)
    results = engine.amend(jobs.unionByName(broken), html=True).persist()
    report = {r["job"]: r for r in engine.report(results).collect()}
    assert (report["eins"]["commands"], report["eins"]["applied"], report["eins"]["manual"]) == (4, 3, 1)
    assert (report["eins"]["checked"], report["eins"]["equal"], report["eins"]["deviating"], report["eins"]["extra"]) == (2, 1, 1, 1)
    assert (report["zwei"]["applied"], report["zwei"]["deferred"]) == (2, 1) and report["eins"]["reasons"] == "Befehl nicht erkannt:1"
    assert set(report) == {"eins", "zwei", "drei", "vier"} and engine.totals(engine.report(results)).first()["jobs"] == 4
    assert {(r["job"], r["label"], r["kind"]) for r in engine.synopsis(results).where("job = 'eins'").collect()} == {("eins", "§ 1", "CHANGED"), ("eins", "§ 3", "NEW")}
    assert engine.laws(results).count() >= 2 and "<html" in engine.pages(results).first()["html"]
    page = engine.report_page(engine.report(results))
    assert page.count("<tr>") == 6 and "Befehl nicht erkannt:1" in page and "kaputt" in page and "4 Aufträge" in page
    inputs.write_report(engine.report(results), str(tmp_path / "report"))
    base = inputs.read_baseline(spark, str(tmp_path / "report"))
    assert {r["job"] for r in base.collect()} == set(report)
    worse = regressions(base, engine.report(results).where("job != 'zwei'"), "job", ["applied"], ["manual"])
    assert [tuple(r) for r in worse.collect()] == [("zwei", "job", 1, None)]
    results.unpersist()


def test_files_are_told_apart_by_content(spark, tmp_path):
    for name, data in (("a", b"PK\x03\x04"), ("b", b"%PDF-1.4"), ("c", XML.encode()), ("d", b"Text \xff")):
        (tmp_path / name).write_bytes(data)
    assert {r["path"][-1]: r["kind"] for r in inputs.scan_files(spark, str(tmp_path)).collect()} == {"a": "zip", "b": "pdf", "c": "xml", "d": "text"}


def test_command_line(tmp_path, capsys):
    from lexloom.cli import main

    base, act = tmp_path / "base.txt", tmp_path / "act.txt"
    base.write_text(BASE)
    act.write_text(ACT)
    assert main([str(base), str(act), "--law", str(tmp_path / "new.txt"), "--synopsis", str(tmp_path / "s.html"), "--dump-commands"]) == 0
    assert "3 von 4" in capsys.readouterr().out and read_law((tmp_path / "new.txt").read_text()).norm("§ 3")
    assert main([str(base), str(act), "--official", str(base)]) == 3
    assert main([str(base)]) == 1
    act.write_text(ACT.replace("Probe“", "Fehlt“").replace("Absatz 2 wird auf", "Absatz 9 wird auf").replace("Nach § 2", "Nach § 9"))
    assert main([str(base), str(act)]) == 2


def test_references(tmp_path, monkeypatch):
    from lexloom.sources import locate

    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "cache"))
    (tmp_path / "law.txt").write_text("x")
    assert locate.fetch(str(tmp_path / "law.txt")) == b"x"
    asked = []
    get = lambda url: asked.append(url) or b"data"
    assert locate.fetch("gii:BGB Test", "https://portal.example/", get) == locate.fetch("gii:BGB Test", "https://portal.example/", get) == b"data"
    assert asked == ["https://portal.example/bgb_test/xml.zip"]  # the second time from the cache
    with pytest.raises(FileNotFoundError):
        locate.fetch("fehlt.txt")
    assert locate.pick(["bgb_2", "zpo"], "bgb") == "bgb_2"
    with pytest.raises(LookupError, match="2 entries"):
        locate.pick(["bgb", "bgb_2"], "bgb")


def test_an_abbreviation_is_looked_up_in_the_directory(tmp_path, monkeypatch):
    import urllib.error

    from lexloom.sources import locate

    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path))
    pages = {"https://p/gii-toc.xml": b"<link>http://p/uwg_2004/xml.zip</link><link>http://p/bgb/xml.zip</link>", "https://p/uwg_2004/xml.zip": b"zip"}

    def get(url):
        if url not in pages:
            raise urllib.error.HTTPError(url, 404, "not found", None, None)
        return pages[url]

    assert locate.fetch("gii:UWG", "https://p", get) == b"zip"
    with pytest.raises(LookupError):
        locate.fetch("gii:zpo", "https://p", get)
    with pytest.raises(ValueError, match="PDF"):
        inputs.read_text_file(b"%PDF-1.4")


def test_heads_of_state_laws():
    law = read_law(
        "XG: Landesgesetz (XG) Vom 1. Mai 1978 (GVBl. S. 5)\nLandesgesetz\n(XG)\nVom 1. Mai 1978\nI. Abschnitt Grundsätze\nArt. 1  Zweck\n(1) ¹Eins ist. ²Zwei ist.\n"
        "(2) Es dient:\n1. erstens,\n2. zweitens.\nII. Abschnitt Reviere\n1. Allgemeines\nArt. 3  Namen\nDer Bestand wird\nfestgestellt.\n2. Besonderes\nArt. 8  Flächen\n"
        "(1) Die Regeln nach\nArt. 11 Abs. 6 sind anzuwenden⁶).\n6) [Amtl. Anm.:] Fundstelle\nArt. 9  (aufgehoben)\nArt. 10 (Änderung)\n"
    )
    assert (law.title, law.abbreviation) == ("Landesgesetz", "XG")
    assert [n.label for n in law.norms] == ["Art. 1", "Art. 3", "Art. 8", "Art. 9", "Art. 10"]
    assert [(d.label, d.title, d.code) for d in law.divisions] == [("I. Abschnitt", "Grundsätze", "001"), ("II. Abschnitt", "Reviere", "002"), ("1.", "Allgemeines", "002.1"), ("2.", "Besonderes", "002.2")]
    assert law.norm("Art. 8").division == 3 and "⁶) [Amtl. Anm.:]" in law.norm("Art. 8").paragraphs[0].text and law.norm("Art. 9").repealed and not law.norm("Art. 10").repealed
    assert read_law(write_law(law)) == law


@pytest.mark.parametrize(
    ("head", "short", "abbreviation"),
    [("(Zuständigkeitsgesetz – Z-Gesetz)", "Zuständigkeitsgesetz", "Z-Gesetz"), ("(GO)", "Titel", "GO"), ("(Gemeindeordnung – GO –)", "Gemeindeordnung", "GO"), ("Vom 3. Mai 2000", "Titel", None)],
)
def test_short_titles(head, short, abbreviation):
    law = read_law(f"Titel\n{head}\n§ 1  A\n(1) Text.\n")
    assert (law.short, law.abbreviation) == (short, abbreviation) and read_law(write_law(law)) == law


def test_a_table_of_contents_keeps_the_headings_that_it_cites():
    law = read_law("Gesetz\n(G)\nInhaltsübersicht\nAbschnitt 1 Allgemeines\n§ 1 | Geltung\nAbschnitt 2 Zulassung\n§ 4 | Gründe\nAbschnitt 1 Allgemeines\n§ 1  Geltung\n(1) Es gilt.\n")
    assert law.norm("Inhaltsübersicht").paragraphs[0].text.split("\n")[2] == "Abschnitt 2 Zulassung" and len(law.divisions) == 1
    assert read_law(write_law(law)) == law


def test_headings_known_by_their_place_only():
    law = read_law("Gesetz\n(G)\nI. Form und Aufgaben\n§ 1  Name\n(1) Der Rat ist eine Anstalt.\nII. Organisation\n1. Der Rat\n§ 15  Bestand\n(1) Er besteht aus Mitgliedern.\n")
    assert [(d.label, d.title) for d in law.divisions] == [("I.", "Form und Aufgaben"), ("II.", "Organisation"), ("1.", "Der Rat")] and law.norm("§ 15").division == 2


def test_annexes_and_their_numbers():
    law = read_law("Gesetz\n§ 1  Zweck\n(1) Es gilt.\nAnlage\n(zu § 1 Absatz 1)\nErster Abschnitt  Aufgaben\nNummer 6\nAmt\n(1) Die erste.\n(2) Die zweite; § 1 gilt.\nNummer 23\nPolizei\n(1) Die dritte.\nAnlage 2\nMuster\n")
    assert [n.label for n in law.norms] == ["§ 1", "Anlage", "Anlage Nummer 6", "Anlage Nummer 23", "Anlage 2"] and not law.divisions
    named = read_law("Gesetz\n§ 1  A\nText.\nAnlage 1  Plan\nAusbildungsabschnitt 1  Grundlagen\n(1) Eins.\nAusbildungsabschnitt 2\n(1) Zwei.\n")
    assert [n.label for n in named.norms][2:] == ["Ausbildungsabschnitt 1", "Ausbildungsabschnitt 2"] and read_law(write_law(named)) == named
    assert [p.number for p in law.norm("Anlage Nummer 6").paragraphs] == [None, "1", "2"] and read_law(write_law(law)) == law
    from lexloom.plans.apply import apply_all
    from lexloom.plans.recognise import recognise

    new, entries = apply_all(law, [recognise("In Nummer 6 Absatz 2 der Anlage wird das Wort „zweite“ durch das Wort „neue“ ersetzt.") or recognise("In Anlage Nummer 6 Absatz 2 wird das Wort „zweite“ durch das Wort „neue“ ersetzt.")])
    assert entries[0].status == "APPLIED" and new.norm("Anlage Nummer 6").paragraphs[2].text.startswith("Die neue")


def test_jobs_over_federal_xml_and_archives(spark, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "base.xml").write_bytes(XML if isinstance(XML, bytes) else XML.encode())
    with zipfile.ZipFile(folder / "base.zip", "w") as z:
        z.writestr("a.xml", XML)
    (folder / "plan.pdf").write_bytes(b"%PDF-1.4")
    title = inputs.read_law_file((folder / "base.xml").read_bytes()).title
    label = next(n.label for n in inputs.read_law_file((folder / "base.xml").read_bytes()).norms if n.label.startswith("§"))
    (folder / "act.txt").write_text(f"Artikel 1\nDas {title} wird wie folgt geändert:\n1. {label} wird aufgehoben.")
    (folder / "other.txt").write_text("not named by any job")
    lines = ["xml\tbase.xml\tact.txt\t-\t-\t-", "zip\tbase.zip\tact.txt\t-\t-\t-", "pdf\tbase.xml\tact.txt,plan.pdf\t-\t-\t-", "gone\tbase.xml\tnone.txt\t-\t-\t-"]
    (tmp_path / "jobs.tsv").write_text("\n".join(lines) + "\n")
    jobs = inputs.with_texts(spark, inputs.read_job_list(spark, str(tmp_path / "jobs.tsv")), str(folder))
    results = engine.amend(jobs).persist()
    report = {r["job"]: r for r in engine.report(results).collect()}
    assert all((report[k]["commands"], report[k]["applied"]) == (1, 1) for k in ("xml", "zip"))
    assert "plan.pdf" in report["pdf"]["error"] and "none.txt: no such file" in report["gone"]["error"]
    norms = inputs.read_law_file((folder / "base.xml").read_bytes()).norms
    assert len(engine.synopsis(results, full=True).where("job = 'xml'").collect()) >= len(norms) - 1


def test_laws_of_documents_without_lines_or_that_open_with_items(spark, tmp_path):
    import duckdb

    from lexloom.plans import catalogue

    texts = ["94.182.225.142 eins\n1. zwei\n- drei\na) vier", None, "", " \n  ", "  fünf  \n\nsechs"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.law_round_trip(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalogue.ORACLE_SQL["law_round_trip"]).fetchall()) and len(got) == 2
