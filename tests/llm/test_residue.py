import pytest
from pyspark.sql import functions as F

from scholion.llm import residue
from scholion.llm.residue import SLOT, ResidueIndex, exemplar_vocabulary, find_residue, without_residue

SCHEMA = "record_id long, title string, full_text string, summary_mode string"
INDEX = ResidueIndex({w: 3 for w in exemplar_vocabulary()} | {"page": 400, "the": 900, "text": 300, "sample": 300, "article": 200, "content": 100, "is": 800, "not": 700, "this": 600, "a": 900, "of": 900, "to": 900, "in": 900}, 1000)


@pytest.mark.parametrize(
    "text",
    [
        "The {{species}} samples were taken and analysed.",
        "${abstract.body}",
        "Loss of <<DATE>> doubled it in 4 mice.",
        "%ARTICLE_SUMMARY%",
        "As shown by [AUTHOR NAME] the trend is clear.",
        "[Click here to enter text]",
        "Results ##SECTION_9_CONTENT##",
        "{0} of {1} donors, see {2}",
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.",
        "Please enable JavaScript to view this article.",
        "Sorry, the link you followed is broken. Wait 3 seconds and retry",
        "404\nThe page you asked for is not here. It may have moved.",
        "ATTENTION! AUTOMATED TRAFFIC WAS NOTICED FROM YOUR ADDRESS! TICK THE BOX",
        "占位文字占位文字占位文字占位文字。",
        "Traceback (most recent call last):\n  File",
    ],
)
def test_residue_is_found(text):
    assert INDEX.matches(text)


@pytest.mark.parametrize(
    "text",
    [
        None,
        "",
        "   ",
        "A placeholder probe without target sequence served as a blank in Maridal.",
        "In the workflow file the wildcard `{sample}` expands to one of 12 names.",
        "The lorem test of nonsense reading was given to 31 pupils in Lissova.",
        "The questionnaire ran in the browser with JavaScript; 12 participants lacked it and used paper forms.",
        "Of the 404 loci not found in Ostrel, most were later recovered by exome capture.",
        "Access to the denied-claims register was granted by the board, and an error log was kept.",
        "Template switching produced 12 chimeric reads, which were discarded.",
        "<i>BMAM26</i> shapes p < 0.05 and x > 3 in [12] cases [Article].",
        "[Home](/) [Browse](/all) [Submit](/submit)",
        "Newsletter: enter your e-mail address  [Subscribe]",
    ],
)
def test_papers_that_speak_of_it_are_none(text):
    assert not INDEX.matches(text)


def test_titles_and_modes_may_be_a_bare_mark():
    for text in ("undefined", "_____", "???", "%s", "Please wait", "[no-title]", "待补充", "Untitled document 5"):
        assert INDEX.matches(text, short=True), text
    for text in ("full text (pdf)", "web page text", "仅摘要", "Null mutants of BCAD4"):
        assert not INDEX.matches(text, short=True), text


def test_slots_leave_markup_alone():
    assert not SLOT.search("CO<sub>2</sub> and <em>x</em> &lt;i&gt;")
    assert SLOT.search("&lt;FIRST-AUTHOR&gt;")


def test_very_long_text_is_read_whole():
    text = "Samples were stored at minus twenty degrees. " * 20_000
    assert not INDEX.matches(text)
    assert INDEX.matches(text + "The link you followed is broken.")


def test_query_reports_each_record_once_and_handles_nulls(spark):
    rows = [(1, "T", "Please enable JavaScript to view this article.", "x"), (1, "T", "Please enable JavaScript to view this article.", "x"), (2, None, None, None), (3, "{{title}}", "", ""), (4, "A title", "A text.", "full text (pdf)")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("token", F.lit("clash")).withColumn("count", F.lit(1))
    assert sorted(r[0] for r in find_residue(df).collect()) == [1, 3]
    assert sorted(r["record_id"] for r in without_residue(df).collect()) == [2, 4]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert find_residue(df).count() == 0
    assert residue.build_index(df).rows == 1
