"""Names of elements in operator 4: compounds that an article may use, and trees that are too many to broadcast."""

import pytest

from talkledger.llm import sitetree

KEPT = ["legal-analysis", "market-share", "search-engines", "comment-on-policy", "header-text", "menu-recipes", "share-price", "social-history"]
GONE = ["ad", "ad-slot", "cookie-banner", "sidebar-left", "post-comments", "share-buttons", "related-posts", "newsletter signup", "adBox"]


@pytest.mark.parametrize("names", [KEPT, GONE])
def test_compound_names(spark, names):
    rows = [(i, f"http://h{i}.example/{n}", f'<body><nav>menu</nav><article><h1>T</h1><div class="{n}"><p>said in it</p></div><p>end</p></article></body>') for i, n in enumerate(names)]
    got = sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r["text"] for r in got] == ["T\nsaid in it\nend" if names is KEPT else "T\nend"] * len(names)


def test_trees_of_a_join_and_of_a_broadcast_agree(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    many = sitetree.extract(pages, least_pages=2, names=False).collect()
    monkeypatch.setattr(sitetree, "BROADCAST_ROWS", 0)
    assert sorted(many) == sorted(sitetree.extract(pages, least_pages=2, names=False).collect())
