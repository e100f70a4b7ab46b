import html
import re

import numpy as np

import corpus_pipeline
from skein.llm import blocks, jaccard, secrets, templates, toxicity
from tests.llm.test_models import check_pack


def test_stored_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: r.text for r in blocks.extract(pages).collect()}
    good = 0
    for r in pages.collect():
        main = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", main)]
        good += got[r.page_id] == "\n".join(b for b in want if b)
    assert good >= 0.99 * len(got)


def test_other_layouts_and_odd_pages(spark):
    body = "This is a long sentence of the story that is told here, and it goes on for quite some time. " * 3
    page = f"<html><body><header class=top><a href=/>Home</a></header><ul class=menu><li><a href=a>One</a><li><a href=b>Two</a></ul><main><h1>Title &amp; more</h1><p>{body}<p>Second   para\n{body}</main><div class='comments'><p>I do not agree with any of this, dear writer.</p></div><form><p>Subscribe now</p></form></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "", ""), (None, "v", "<p>"), (5, "w", "<b>" * 5000 + "x"), (5, "w", "<b>" * 5000 + "x")]
    train = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    weights = blocks.learn(train)
    net = blocks.Labeller(blocks.PATH + blocks.WORDS + 5, np.random.RandomState(5))
    net.w = weights
    parsed = blocks.parse(page)
    kept = [b[1] for b, k in zip(parsed, net.label([blocks.features(parsed)])[0]) if k]
    assert kept == ["Title & more", body.strip(), "Second para " + body.strip()]
    out = blocks.extract(train.union(spark.createDataFrame(rows, train.schema)))
    assert out.count() == train.count() + len(rows)
    assert out.where("url is null or url = ''").where("text = ''").count() == 2
    assert blocks.extract(train.limit(0)).count() == 0


def test_head_left_open():
    head = '<html><head><meta charset="utf-8"><title>Name</title><script>var a = "<p>no</p>";</script><style>p {}</style>\n'
    body = "<p>One <b>two</b></p><div>Three</div>"
    want = [b[1] for b in blocks.parse(f"{head}</head><body>{body}</body></html>")]
    assert want == ["One two", "Three"]
    for page in (f"{head}<body>{body}</body></html>", f"{head}{body}</html>", head + body, f"{head}<body>{body}"):
        assert [b[1] for b in blocks.parse(page)] == want
    assert [b[1] for b in blocks.parse(head + "Bare text" + body)] == ["Bare text", *want]
    assert [b[1] for b in blocks.parse(head + "<a href=x>Link</a>" + body)] == ["Link", *want]
    assert [b[1] for b in blocks.parse(head + "<noscript><img src=x></noscript><template><p>no</p></template><body>" + body)] == want


def test_gradients():
    rnd = np.random.RandomState(1)
    net = blocks.Labeller(6, rnd)
    net.w = {k: w.astype(np.float64) for k, w in net.w.items()}
    x, n, y = rnd.randn(3, 5, 6), np.array([5, 3, 1]), rnd.randint(0, 2, (3, 5)).astype(float)
    real = np.arange(5) < n[:, None]

    def loss():
        p = net.forward(x, n)[0]
        return float(-((y * np.log(p) + (1 - y) * np.log(1 - p)) * real).sum() / real.sum())

    grad = net.gradients(x, n, y)
    for k, w in net.w.items():
        i = tuple(rnd.randint(0, s) for s in w.shape)
        old = w[i]
        w[i] = old + 1e-3
        up = loss()
        w[i] = old - 1e-3
        down = loss()
        w[i] = old
        assert abs((up - down) / 2e-3 - grad[k][i]) < 2e-3, k


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.scores(docs, model).where("score >= 0.5").collect()}
    one = corpus_pipeline.toxic(spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect()} - bad
    two = corpus_pipeline.near_duplicates(spark, one, sf)
    assert {r.doc_id for r in two.collect()} == {r.component_id for r in jaccard.near_duplicates(one).collect()}
    three = corpus_pipeline.contaminated(spark, two, sf)
    hit = {r.doc_id for r in templates.flag(two, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - hit
    four = corpus_pipeline.secret(spark, three, sf).collect()
    assert len(four) == three.count()
    assert secrets.report(spark.createDataFrame(four, docs.schema)).where("n_assign + n_access + n_hex > 0").count() == 0
    assert all(f.columns == docs.columns for f in (one, two, three))
    check_pack([(r.doc_id, r.text, r.source) for r in four], corpus_pipeline.run(spark, sf).collect())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_deep_comments_do_not_leak_and_articles_are_whole(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    deep = '<section class="a b c d e f g h i j k l m comments">' + "<div>" * 14 + "<p>LEAKMARK a reader says many things here, long enough to look like the prose of the article.</p>" + "</div>" * 14 + "</section>"
    altered = [(10 ** 6 + r.page_id, r.url, r.html.replace("</body>", deep + "</body>")) for r in pages.limit(60).collect() if "</body>" in (r.html or "")]
    prose = "Prose that is long enough to be kept by anyone. " * 4
    own = [(1, "u", f"<html><body><article><h1>Title</h1><p>{prose}</p><ul><li>One</li><li>Two</li></ul><pre>code</pre><table><tr><td>cell</td></tr></table>"
                    f"<div class='related'><p>{prose}</p></div></article><aside>{'<div>' * 20}<p>{prose}</p>{'</div>' * 20}</aside></body></html>")]
    out = {r.page_id: r.text for r in blocks.extract(pages.unionByName(spark.createDataFrame(altered + own, "page_id long, url string, html string"))).collect() if r.page_id >= 10 ** 6 or r.page_id == 1}
    assert not [k for k, t in out.items() if "LEAKMARK" in t] and len(altered) > 40
    mine = blocks.extract(spark.createDataFrame(own, "page_id long, url string, html string")).first().text
    assert mine.split("\n") == ["Title", prose.strip(), "One", "Two", "code", "cell"]


def test_a_very_long_block_is_whole(spark):
    prose = "word " * 200_000
    page = spark.createDataFrame([(1, "u", f"<html><body><main><p>{prose}</p></main></body></html>"), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in blocks.extract(page).collect()}
    assert got == {1: prose.strip(), 2: "", None: ""}
