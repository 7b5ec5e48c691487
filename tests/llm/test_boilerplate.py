import pytest
from pyspark.sql import functions as F

from scholion.llm.boilerplate import density, find_page_lines, link_share, main_text, page_lines

PAGE = "\n".join(
    [
        "Home | Journals | Topics | About us",
        "",
        "Introduction",
        "Sampling of mice ended early because optical mapping failed on 14 occasions. We examined it again.",
        "Related articles",
        "• Loss of BQAW12 alters issue backlog in plugin authors (2024)",
        "Oatmeal cookies were offered as the control snack, and participants could accept or reject all of them.",
        "* Your privacy choices: necessary · statistics · marketing",
        "© 2020 Tavesk, Ulverpool. All rights reserved.",
        "ARTICLES  AUTHORS  REVIEWERS  EDITORS",
        "References",
    ]
)


def test_furniture_lines():
    assert page_lines(PAGE) == [1, 5, 6, 8, 9, 10]


@pytest.mark.parametrize("text", [None, "", "\n\n", "One sentence of the paper."])
def test_nothing_to_find(text):
    assert page_lines(text) == []


def test_page_without_paper_is_all_furniture():
    assert page_lines("Menu\nAdvertisement\n首页 | 期刊 | 作者中心 | 关于我们") == [1, 2, 3]


@pytest.mark.parametrize(
    "line",
    ["A privacy policy for donors was drafted in Izmenka and is quoted in full in the appendix.", "Subscribers to the Tavesk newsletter were invited by mail; 17 signed in to the study site.", "Copyright of the recorded songs rests with the families in Ostrel.", "2. Materials and methods", "上述发现提示测序深度可作为单倍型的参考指标。"],
)
def test_remarks_of_the_paper_stay(line):
    assert link_share(line)[2] == 0


@pytest.mark.parametrize(
    "line",
    ["This website use cookies to keep the site running. More on this in our policy.", "Were you looking for “Effects of BFAQ1 on plasma ferritin”?", "Home › Annals › Volume 3 › Issue 4", "Get e-mail alerts for Annals of X", "[Home](/) [Browse](/all)", "Anmelden  Warenkorb (0)", "本月热门"],
)
def test_controls_and_notices_go(line):
    chars, _, links, _ = link_share(line)
    assert links == chars > 0


def test_density_falls_with_links():
    assert density(200, 1, 0, 0, 1000, 100) > density(200, 4, 150, 3, 1000, 100) > density(200, 4, 200, 3, 1000, 100) == 0


def test_lines_are_split_at_line_feeds_alone():
    assert page_lines("Menu\rMenu\nText of the paper goes on here.\x0b\nMenu")[-1] == 3


def test_query(spark):
    schema = "record_id long, title string, full_text string, abstract string, summary_mode string"
    rows = [(1, "T", PAGE, "Menu\nA sentence of the paper.", "m"), (2, None, None, None, None), (3, "{{title}}", PAGE, None, "m")]
    df = spark.createDataFrame(rows, schema).withColumn("field", F.lit("clash")).withColumn("line_no", F.lit(0))
    got = sorted((r["record_id"], r["field"], r["line_no"]) for r in find_page_lines(df).collect())
    assert got == [(1, "abstract", 1)] + [(1, "full_text", n) for n in (1, 5, 6, 8, 9, 10)]
    assert find_page_lines(df.limit(0)).count() == 0
    kept = {r["record_id"]: r["main_text"] for r in main_text(df).collect()}
    assert kept[2] is None and kept[1].split("\n")[1] == "Introduction" and "Menu" not in kept[1]


MENU = "Home | Journals | About | Contact"
NOTICE = "Consent saved 2 days ago."
MIXED = "The habits of kelp in warm water. " + NOTICE


def test_density_alone_decides_on_a_line_that_is_partly_link():
    """The same line stays or goes with the threshold that the rest of the page sets, and with its share of link characters."""
    text = "Kelp grows in cold water near the coast of many lands, and few beetles eat of it in any season."
    assert link_share(MIXED)[2] < link_share(MIXED)[0] and link_share(MIXED)[3] == 1
    assert page_lines("\n".join([MENU, text, MIXED, text])) == [1, 3]
    assert page_lines("\n".join([MENU, text, "Kelp is it.", MIXED + " " + text * 9, text])) == [1]  # thin text, much text in the line
    assert page_lines("\n".join([MENU, text, text, MIXED.replace(NOTICE, "It is so.")])) == [1]


def test_the_denser_container_sets_the_threshold(monkeypatch):
    """Without the formula the answer changes: no word list decides here."""
    text = "Kelp grows in cold water near the coast of many lands, and few beetles eat of it in any season."
    page = "\n".join([MENU, text, MIXED, text])
    monkeypatch.setattr("scholion.llm.boilerplate.density", lambda chars, tags, link_chars, *_: 0.0 if link_chars >= chars else 1.0)
    assert page_lines(page) == [1]


def test_lines_are_judged_alike_whatever_their_length():
    menu = " | ".join(["Home", "Journals", "About", "Contact"] * 40)
    text = "Kelp grows in cold water. " * 40
    assert page_lines("\n".join([menu, text])) == [1]
    assert page_lines("\n".join(["We use cookies on this site " + "and on many others " * 60 + "too.", text])) == [1]
