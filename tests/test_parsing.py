"""Structure of forms, decisions, statutes and pages on small cases."""

from __future__ import annotations

import random
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clausegrid.operators import parsing


def brute_chunks(text: str, longest: int) -> list[str]:
    if len(text) <= longest:
        return [text]
    done, now = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if now and len(now) + len(s) + 1 > longest:
            done, now = [*done, now.strip()], s
        else:
            now = f"{now} {s}".strip() if now else s
    return done + ([now.strip()] if now else [])


def test_headings_of_a_form_count_in_order_only(spark: SparkSession) -> None:
    text = "Form\n2. Too early\n1. Parties\r\n1. Last Name\n3. Later\n\n  2. Rental Unit  \n4. Jump\n3. Contact\n18. Beyond\n2. Again"
    rows = [(1, text), (2, None), (3, " \n\n"), (4, "1. Parties"), (5, "no heading\nat all"), (6, "\n".join(f"{n}. x" for n in range(1, 20)))]
    got = parsing.form_sections(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    of = lambda d: [(r["section"], r["number"], r["text"]) for r in sorted(got, key=lambda r: r["section"]) if r["doc_id"] == d]
    assert of(1) == [
        (0, "form_00_preamble", "Form 2. Too early"),
        (1, "form_01_parties_to_the_agreement", "1. Parties 1. Last Name 3. Later"),
        (2, "form_02_rental_unit", "2. Rental Unit 4. Jump"),
        (3, "form_03_contact_information", "3. Contact 18. Beyond 2. Again"),
    ]
    assert of(2) == of(3) == []
    assert of(4) == [(1, "form_01_parties_to_the_agreement", "1. Parties")]
    assert of(5) == [(0, "form_00_preamble", "no heading at all")]
    assert [x[0] for x in of(6)] == list(range(1, 18)) and of(6)[-1][2] == "17. x 18. x 19. x"


def test_chunks_hold_whole_sentences(spark: SparkSession) -> None:
    r = random.Random(7)
    texts = [" ".join("w" * r.randint(1, 40) + r.choice(".!? ,") for _ in range(r.randint(1, 60))) for _ in range(40)] + ["", "x" * 500, "x" * 300 + ". y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", parsing.sentence_chunks(F.col("text"), 200).alias("c"))
    assert {x["id"]: x["c"] for x in df.collect()} == {i: brute_chunks(t, 200) for i, t in enumerate(texts)}


def test_long_sections_are_cut_at_subsections(spark: SparkSession) -> None:
    text = "Intro. (1) " + "a " * 30 + "(2) " + "One is this. " * 12 + "(3) end"
    rows = spark.createDataFrame([("26", text), ("27", "short (1) text")], "number string, text string")
    got = [(x["number"], x["text"]) for x in parsing.statute_chunks(rows, 100).orderBy("number").collect()]
    assert got[0] == ("26", "Intro.") and got[1][1].startswith("(1) a a") and ("27", "short (1) text") in got
    assert all(len(t) <= 100 for _, t in got) and sum(t.count("One") for _, t in got) == 12


def analysed(spark: SparkSession, html: list[str | None]) -> dict[int, tuple]:
    found = parsing.analyses(spark.createDataFrame(list(enumerate(html)), "page_id int, html string"))
    return {r["page_id"]: (r["found"], r["summary"], r["principle"]) for r in found.collect()}


def test_analyses(spark: SparkSession) -> None:
    p = lambda t: f"<p>{t}</p>"
    long = "The landlord entered the unit without any notice at all, again and again. Under s. 26 of the Act that is an offence."
    plain = [p(f"Paragraph {n} of the preamble says a good deal more than fifty signs.") for n in range(5)]
    pages = [
        "<h1>Case</h1>" + p("Before the analysis stands this paragraph of some length.") + "<H2>Reasons for Decision.</H2>" + p("Short.") + p(long) + "<h3>4. Numbered heading</h3>" + p("What follows a numbered heading counts as well.") + "<h2>Order</h2>" + p(long),
        "<h2>Analysis</h2>" + p(long) + "<h3>Any new heading</h3>" + p("This comes too late to be counted, as a heading has ended it."),
        "<h2>Analysis</h2><h2>Background</h2>" + "".join(plain),
        "".join(plain[:3]),
        p("Too little."),
        None,
        "<nav>" + p(long) + "</nav><!-- " + p(long) + " --><footer>" + p(long) + "</footer>",
        "<h2>Analysis</h2><h2>Findings</h2>" + p("word " * 600) + "<h2>" + "A heading that is far too long to be taken for the beginning of another part of it" + "</h2>" + p("tail " * 20),
    ]
    got = analysed(spark, pages)
    assert sorted(got) == [0, 1, 2, 3, 7]
    assert got[0] == ("analysis", long + " What follows a numbered heading counts as well.", "26 of the Act that is an offence.")  # a section sign ends a sentence
    assert got[1][:2] == ("analysis", long)
    assert got[2][0] == "paragraphs" and got[2][1].startswith("Paragraph 3") and got[2][1].count("Paragraph") == 2
    assert got[3][1].count("Paragraph") == 3 and got[3][2].startswith("Paragraph 0")
    assert len(got[7][1]) <= 2000 and got[7][1].endswith("word") and len(got[7][2]) == 500


def test_statute_tree(spark: SparkSession) -> None:
    html = (
        '<table><tr><td><p class="TOCid">26.</p></td><td><p class="table">Entry</p></td></tr></table>'
        '<a name="BK1"></a><a name="other"></a><p class="section">26 A landlord may enter,</p><p class="paragraph">as follows:</p><p>not counted</p>'
        '<p class="subsection">(1) with notice;</p><p class="paragraph">in writing;</p><p class="subsection">(2) without;</p><p class="subsection">(1) again.</p>'
        '<p class="headnote section">without number</p><p class="paragraph">lost</p><a name="BK2"></a>'
        '<p class="section">27.1 No parts.</p><p class="section">26 Repeated</p><p class="subsection">(9) lost too</p>'
    )
    rows = spark.createDataFrame([(1, html), (2, None), (3, "<p>nothing</p>")], "page_id int, html string")
    got = [tuple(r)[2:] for r in parsing.statute_tree(rows, F.lit("u")).orderBy("place").collect()]
    assert got == [
        ("26", None, "Entry", "entry_rights", "u#BK1", "26 A landlord may enter, as follows:"),
        ("26(1)", "26", "Entry", "entry_rights", "u#BK1", "(1) with notice; in writing; (1) again."),
        ("26(2)", "26", "Entry", "entry_rights", "u#BK1", "(2) without;"),
        ("27.1", None, "", "entry_rights", "u#BK2", "27.1 No parts."),
    ]


def test_reading_order(spark: SparkSession) -> None:
    blocks = [("f", 1, 0, 300.0, 10.0), ("f", 1, 1, 50.0, 90.0), ("f", 1, 2, 60.0, 20.0), ("f", 1, 3, 300.0, 5.0), ("f", 1, 4, 60.0, 20.0), ("f", 1, 5, -5.0, 1.0), ("f", 2, 0, None, None), ("f", 2, 1, 150.0, 0.0), ("f", 2, 2, 250.0, 0.0)]
    got = parsing.in_reading_order(spark.createDataFrame(blocks, "file string, page int, n int, x0 double, y0 double")).collect()
    order = lambda p: [(r["n"], r["col"]) for r in sorted(got, key=lambda r: r["place"]) if r["page"] == p]
    assert order(1) == [(2, 0), (4, 0), (1, 0), (5, 1), (3, 1), (0, 1)]
    assert order(2) == [(0, 0), (1, 1), (2, 1)]


def test_regulation_sections(spark: SparkSession) -> None:
    html = (
        '<p class="headnote-e">Old</p><p class="headnote-e">Doors</p><p class="section-e">1.(1) Doors close.</p><p class="paragraph-e">always</p><p>not this</p>'
        '<p class="section-e">without number</p><p class="clause-e">lost</p><p class="headnote-e">Windows</p><p class="section-e">2 Windows open.</p>'
        '<p class="section-e">3. Untitled.</p><p class="headnote-e">Later</p><p class="section-e">1. Doors again.</p>'
    )
    plain = "<p>Before</p><p>1. One</p><p>more</p><p></p><p>2) Two</p><p>1. One again</p>"
    rows = spark.createDataFrame([(1, html), (2, plain), (3, None)], "page_id int, html string")
    got = [tuple(r) for r in parsing.regulation_sections(rows).select("page_id", "number", "title", "text", "found_by").orderBy("page_id", "place").collect()]
    assert got == [
        (1, "1", "Later", "1.(1) Doors close. always", "class"),
        (1, "2", "Windows", "2 Windows open.", "class"),
        (1, "3", "Section 3", "3. Untitled. Later", "class"),
        (2, "1", "Section 1", "1. One more", "paragraphs"),
        (2, "2", "Section 2", "2) Two", "paragraphs"),
        (2, "1", "Section 1", "1. One again", "paragraphs"),
    ]


def test_chunks_keep_all_words(spark: SparkSession) -> None:
    text = " ".join(f"({i}) Sentence number {i} goes on and on." if i % 9 == 0 else f"Sentence number {i} goes on and on." for i in range(300))
    rows = spark.createDataFrame([("26", text)], "number string, text string")
    parts = [r["text"] for r in parsing.statute_chunks(rows).orderBy("chunk").collect()]
    assert all(len(p) <= parsing.LONGEST_CHUNK for p in parts)
    assert " ".join(parts).split() == text.split()
