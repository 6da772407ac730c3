"""Main text: wrappers, roots and site templates that no list of names knows."""

from collections import defaultdict

import pytest
from corpusflow.llm.extraction import RECURRING_PAGES, extracted, main_text, page_subtrees, site_templates

CASES = [
    ("<body><form id='aspnetForm'><div><article><h1>T</h1><p>body text</p></article></div></form></body>", "T\nbody text"),
    ("<body><header><div><article><p>story</p></article></div></header></body>", "story"),
    ("<body><form><div><h1>X</h1><p>most of the text of the page is in this form</p></div></form></body>", "X\nmost of the text of the page is in this form"),
    ("<body><form><p>find</p></form><p>main text goes here at length</p></body>", "main text goes here at length"),
    ("<article><table><tr class='header'><th>Year</th></tr><tr><td class='notice'>1999</td></tr></table></article>", "Year\n1999"),
    ("<main><h1>Head</h1><p>intro</p><article><p>body</p></article></main>", "Head\nintro\nbody"),
    ("<main><h1>Head</h1><p>long body</p><section><article><a href=x>teaser</a></article></section></main>", "Head\nlong body\nteaser"),
    ("<body><article></article><h1>H</h1><p>text here</p></body>", "H\ntext here"),
    ("<article><h2 class='related'>Related work</h2><p>text</p></article>", "Related work\ntext"),
    ("<body><article><p>story</p></article><div class='comments'><p>a comment longer than the story</p><article class='comment'><p>more</p></article></div></body>", "story"),
    ("<body><aside><article><p>teaser</p></article></aside><p>text of the page</p></body>", "text of the page"),
    (None, ""), ("", ""), ("<p>", ""),
]


@pytest.mark.parametrize("html,text", CASES)
def test_no_page_loses_its_article(html, text):
    assert main_text(html) == text


LEGAL = "The publisher of this site takes no responsibility for what is written here. " * 5


def site(n, host="site.example"):
    """Pages with furniture in plain elements, and near copies of one story on the same host."""
    rows = []
    for k in range(n):
        own = " ".join(f"w{k}x{j}" for j in range(80))
        rows.append((k, f"http://{host}/{k}", f"<body><p>Subscribe today for more.</p><h1>Title {k}</h1><p>{own}</p><p>shared by many documents</p>"
                                             f"<p>{own[::-1]}</p><div>{LEGAL}</div><div><a href=a>One</a> <a href=b>Two</a></div></body>"))
    for k in range(n):
        rows.append((1000 + k, f"http://{host}/copy{k}", f"<body><article><h1>Copy {k}</h1><div><p>the same story, told on many pages</p><div>{LEGAL}</div></div></article></body>"))
    return rows


def test_the_count_removes_furniture_without_marks(spark):
    pages = site(8) + [(2000, None, None), (2001, "http://other.example/", f"<body><p>alone</p><div>{LEGAL}</div></body>")]
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    for k in range(8):
        own = " ".join(f"w{k}x{j}" for j in range(80))
        assert got[k] == f"Title {k}\n{own}\nshared by many documents\n{own[::-1]}"
        assert got[1000 + k].startswith(f"Copy {k}\nthe same story, told on many pages")
    assert got[2000] == "" and got[2001] == "alone\n" + " ".join(LEGAL.split())


def test_templates_equal_a_plain_count(spark):
    pages = site(8) + site(3, "small.example")
    on, rows = defaultdict(set), []
    for _, url, html in pages:
        page, found = page_subtrees(html)
        rows.append((url.split("/")[2], found))
        for x in found:
            on[url.split("/")[2], x].add(page)
    want = sorted(sorted(x for x in found if len(on[host, x]) >= RECURRING_PAGES) for host, found in rows)
    got = site_templates(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted(sorted(r.template) for r in got) == [w for w in want if w]
