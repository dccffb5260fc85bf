import pytest

from lakeloom.llm.residue import residue_cases, residue_cover
from lakeloom.llm.truncation import truncated_values, truncation_rates

CASES = ["{{ product.name }}", "${title}", "[[ headline ]]", "Your text here: Popa", "404", "Error 503 - backend fetch failed", "Página Bumalo no encontrada.", "Lorem ipsum dolor amet velutra minim.", "NaN / month", "Activez JavaScript pour afficher Popa.", "Ｅｒｒｏｒ 502 - backend fetch failed", "Tumo: undefined", "Gobamo のページが見つかりません。"]
OTHERS = ["Templates print the price label between two braces, as the guide of Popa shows.", "A 404 page of Popa should explain what happened.", "Placeholder copy is fine in a mock-up, but the baseline needs real words.", "The shop works without scripts except for the search box.", "Popa team: $12.00 / month", "", "   ", "Pricing", "x" * 20_000]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert residue_cover(text) >= 0.55


@pytest.mark.parametrize("text", OTHERS)
def test_others(text):
    assert residue_cover(text) < 0.55


def test_residue_cases(spark):
    nodes = spark.createDataFrame([(1, "a", CASES[0]), (1, "a", CASES[0]), (1, "b", None), (1, "c", "fine\n404")], "page_id long, node_id string, text string")
    pages = spark.createDataFrame([(1, "Not Found | Site"), (2, None), (3, "Guide – Site")], "page_id long, title string")
    assert {tuple(r) for r in residue_cases(nodes, pages).collect()} == {(1, "a"), (1, "c"), (1, "title")}


def nodes_for(spark):
    whole = [f"Readers of {w} asked for the {x} price history in every region." for w in ("Bamo", "Cilu", "Dope", "Fuma") for x in ("new", "old", "public", "hidden")]
    rows = [("s", i, "n", t, t) for i, t in enumerate(whole)]
    rows += [("s", 90, "n", "Readers of Dope asked for the new price hist", "Readers of Dope asked for the new price hist"), ("s", 91, "n", "Readers of Dope asked for the", None), ("s", 92, "n", "Pricing", "Pricing"), ("s", 93, "n", "Readers of Cilu asked for the old price history in every region", None), ("s", 94, "n", "Some words and...", ""), (None, 95, None, None, None)]
    return spark.createDataFrame(rows + rows[-5:], "site string, page_id long, node_id string, text string, name string")


def test_truncated(spark):
    got = {tuple(r) for r in truncated_values(nodes_for(spark)).collect()}
    assert got == {(90, "n", "text"), (90, "n", "name"), (91, "n", "text"), (94, "n", "text")}
    empty = spark.createDataFrame([], "site string, page_id long, node_id string, text string, name string")
    assert truncated_values(empty).count() == 0
    rates = truncation_rates(nodes_for(spark), spark.createDataFrame([(90, "http")], "page_id long, source string"))
    assert {(r.source, r.cut) for r in rates.collect()} == {("http", 2), ("unknown", 2)}


def test_cases_and_kept_make_the_whole(spark, tmp_path):
    from lakeloom.llm.queries import QUERIES

    nodes = [(1, "a", "Please enable JavaScript to view this page."), (1, "b", "Lorem ipsum dolor sit amet, consectetur adipiscing elit."), (1, "c", "Plans for teams"), (1, "c", "Plans for teams"), (2, "a", None), (2, "b", "")]
    spark.createDataFrame(nodes, "page_id long, node_id string, text string").write.parquet(str(tmp_path / "page_nodes.parquet"))
    spark.createDataFrame([(1, "{{title}} | Site"), (2, "Pricing | Site"), (3, None)], "page_id long, title string").write.parquet(str(tmp_path / "crawl_pages.parquet"))
    found = {tuple(r) for r in QUERIES["p5_found"](spark, str(tmp_path)).collect()}
    kept = sorted(((r.page_id, r.node_id, r.text) for r in QUERIES["p5_kept"](spark, str(tmp_path)).collect()), key=str)
    assert found >= {(1, "a"), (1, "b"), (1, "title")}
    assert kept == sorted([(1, "c", "Plans for teams"), (2, "a", None), (2, "b", ""), (2, "title", "Pricing | Site"), (3, "title", None)], key=str)


def test_text_that_only_talks_of_slots_stays():
    from lakeloom.llm.residue import MIN_COVER, residue_cover

    good = "Good line of text here.\n" * 200
    stay = [
        good + "404", good + "Hello {first_name}, welcome!", "I am in the `__init__` method of this class, and it fails", "Use {{ name }} in your Jinja template to print it",
        'printf("%d items", n) prints the number of items', "use ${HOME} to find the home folder", "javax.swing.jbutton", "Set %PATH% before you run the tool",
        "The page said 404 Not Found when I clicked the link", "How we fixed the error that said Access denied", "", " \n ",
    ]
    gone = ["{{ title }}", "Hello {first_name}, welcome to Harbour!", "404 Not Found: /x", "Lorem ipsum dolor sit amet, consectetur", "%%PRICE%%", "Plan: undefined", "From NaN / month for Pro", "Good words.\n{{ a }}"]
    assert [t for t in stay if residue_cover(t) >= MIN_COVER] == []
    assert [t for t in gone if residue_cover(t) < MIN_COVER] == []
    assert residue_cover("error 5 " * 100_000) > 0 and residue_cover("{{" * 100_000) == 0
