"""Pages and lines written by hand, unlike those that the models were trained on; and the decoder of tokens."""

import public_tokenizers
import pytest

from folioquarry.llm import byte_bpe, crf, html_tree, quality_lines

PAGES = [
    (
        """<!doctype html><html lang=en><head><title>Bread</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
        <div id="top-bar"><a href=/>Home</a> <a href=/blog>Blog</a> <a href=/about>About us</a></div>
        <main><article><h1>Baking bread at&nbsp;home</h1><p>Flour, water and salt are all
        that a loaf needs.</p><h2>Method</h2><ol><li>Mix the flour and the water.</li><li>Wait until it has doubled.</ol>
        <p>Bake it for 40&#160;minutes &amp; let it cool.</p></article></main>
        <aside><h3>Popular posts</h3><ul><li><a href=1>Ten cakes</a></li><li><a href=2>Jam for all</a></li></ul></aside>
        <footer><p>&copy; 2024 A Baker. All rights reserved.</p></footer></body></html>""",
        "Baking bread at home\nFlour, water and salt are all that a loaf needs.\nMethod\nMix the flour and the water.\nWait until it has doubled.\nBake it for 40 minutes & let it cool.",
    ),
    (
        """<html><body class="home page-id-7"><header class="site-header"><nav class="main-navigation"><ul><li><a href="#">News</a><li><a href="#">Sport</a></ul></nav></header>
        <div class="cookie-banner"><p>We use cookies to make this site better.</p><button>Accept</button></div>
        <div class="container"><article class="post"><h1 class="entry-title">Rain stops the match</h1><p>The final was stopped after <b>ten</b> minutes of heavy rain, and nobody knew when it would go on.</p>
        <blockquote><p>We had no choice, said the referee.</p></blockquote><p>It goes on tomorrow.</p></article>
        <section id="comments"><h2>2 comments</h2><div class="comment"><p>What a pity!</p></div><div class="comment"><p>I was there and it was awful.</p></div></section></div>
        <form action="/s"><label>Search</label><input name=q></form></body></html>""",
        "Rain stops the match\nThe final was stopped after ten minutes of heavy rain, and nobody knew when it would go on.\nWe had no choice, said the referee.\nIt goes on tomorrow.",
    ),
    (
        """<body><div class="nav"><a href=a>One</a> | <a href=b>Two</a> | <a href=c>Three</a></div><article><p>A page without a heading, cut in the middle of what it says about the sea.<p>The second paragraph is never closed, and the page ends here""",
        "A page without a heading, cut in the middle of what it says about the sea.\nThe second paragraph is never closed, and the page ends here",
    ),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_main_text_of_hand_made_pages(k):
    source, want = PAGES[k]
    assert html_tree.extract(html_tree.default_model(), [source])[0] == want


def test_tag_names_are_read_whole():
    name = "x" + "y" * 200
    assert html_tree.Page(f"<{name} a=\"><p>t</p>").tag[1] == name


CONTENT = [
    "The committee met twice last year, and both meetings were held in public.",
    "She opened the window because the room had become too warm to work in.",
    "In 1987 the bridge was closed for repairs that took almost eleven months.",
    "Le comité s'est réuni deux fois l'année dernière, et personne n'a rien dit.",
]
BOILERPLATE = [
    "BUY NOW!!! LIMITED OFFER!!! CLICK HERE!!!",
    "Home > Products > Chairs > Office > Sale",
    "### %%% ### *** $$$ ### %%% &&&",
    "12 | 45 | 77 | 3 | 9 | 120 | 44 |",
    "great great great great great great great great great great great great",
    "#summer #sale #discount #new #shop #now #deal",
]


def labels(lines):
    made = quality_lines.Lines(["\n".join(lines)])
    model = quality_lines.default_model()
    return crf.viterbi(model, model.emissions(made.active), made.bounds).tolist()


def test_hand_made_lines():
    assert labels(CONTENT) == [quality_lines.CONTENT] * len(CONTENT)
    assert labels(BOILERPLATE) == [quality_lines.BOILERPLATE] * len(BOILERPLATE)
    text = "\n".join(CONTENT * 2)
    got = quality_lines.judge(quality_lines.default_model(), ["\n".join(CONTENT), "\n".join(BOILERPLATE * 2), text])
    assert got["kept"][:2] == [True, False]


def test_tokens_decode_to_the_bytes_that_were_encoded(spark):
    args = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    texts = ["", "plain words", "漢字 and 😀 split over tokens", "a\x00b\r\n\t ", "é" * 50, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as decoded")
    out = byte_bpe.decode(byte_bpe.encode(docs, *args), *args)
    assert {r.doc_id: bytes(r.decoded).decode() for r in out.collect()} == {i: t or "" for i, t in enumerate(texts)}
    pieces = byte_bpe.decode(spark.createDataFrame([([i],) for i in byte_bpe.codec(*args).encode("😀")] + [(None,)], "token_ids array<int>"), *args).collect()
    assert b"".join(r.decoded for r in pieces) == "😀".encode() and len(pieces) > 2
