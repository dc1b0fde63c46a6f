"""Main text of pages that mark it badly or not at all."""

from rainshade.llm.html import extract


def texts(spark, *pages):
    df = spark.createDataFrame([(i, f"http://h{i}.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in extract(df).orderBy("page_id").collect()]


def test_nothing_is_cut_by_its_share_of_the_page(spark):
    long = "many words of the text " * 60
    boxes, nested, cards = texts(
        spark,
        f"<div id=page><h1>Title</h1><p>lead</p><div class=text><p>{long}</p></div></div>",
        f"<div><div><p>first</p><div><p>second</p><div><p>{long}</p></div></div></div><div><p>third part</p></div></div>",
        f"<div><article><p>a card</p></article><div><p>{long}</p></div></div>")
    assert boxes.split("\n") == ["Title", "lead", long.strip()]
    assert nested.split("\n") == ["first", "second", long.strip(), "third part"]
    assert long.strip() in cards.split("\n")


def test_text_beside_an_article_stays(spark):
    long = "many words of the text " * 60
    assert texts(spark, f"<h1>Title</h1><p>a lead</p><article><p>{long}</p></article>") == [f"Title\na lead\n{long.strip()}"]
    assert texts(spark, f"<p>a lead</p><main><p>{long}</p></main><aside>no</aside>") == [f"a lead\n{long.strip()}"]
