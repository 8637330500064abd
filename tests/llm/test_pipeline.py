"""The pipeline's stages on small inputs, each against what it must do to its own input."""

import collections
import re
import time

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from terragrid.llm import html_text, kneser_ney, queries
from terragrid.llm.common import Scratch
from tests.conftest import SF
from tests.llm.test_first_operators import EDGE, edge
from tests.llm.test_substrings import brute

SF2 = SF.replace("0.001", "0.01")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    scratch, kept = Scratch(spark, "test"), [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(scratch.save(stage(spark, kept[-1], SF2), name))
        assert kept[-1].columns == docs.columns, name
    good = labels.where("quality = 1").join(docs, "doc_id")
    assert kept[1].join(good.select("doc_id"), "doc_id").count() == good.count()
    bad = labels.where("quality = 0")
    assert kept[1].join(bad, "doc_id").count() < 0.15 * bad.count()
    # no two exact copies stay, and only documents with a near copy of a smaller id go
    one, two = kept[1].toPandas(), kept[2].toPandas()
    assert two.text.nunique() == len(two) and set(one.text) >= set(two.text)
    sets = {r.doc_id: set(zip(*[r.text.lower().split()[k:] for k in range(5)])) or {r.text} for r in one.itertuples()}
    stay = set(two.doc_id)
    for d in set(one.doc_id) - stay:
        assert max(len(sets[d] & sets[e]) / len(sets[d] | sets[e]) for e in one.doc_id if e < d) >= 0.8
    want = brute(dict(zip(two.doc_id, two.text)), 35)
    three = kept[3].toPandas()
    for r in three.itertuples():
        n, gone, _ = want[r.doc_id]
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == n - gone and r.n_chars == len(r.text)
    pieces = corpus_pipeline.run(spark, SF2)
    assert pieces.agg(F.sum("length")).head()[0] > 0
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n <> 4096").collect()
    assert all(r.n & (r.n - 1) == 0 for r in per)


def brute_kneser_ney(texts, order):
    """Probability of a symbol after a context, by the textbook."""
    counts = [collections.Counter() for _ in range(order + 1)]
    for t in texts:
        x = [1] * (order - 1) + [ord(c) for c in t]
        for i in range(order - 1, len(x)):
            counts[order][tuple(x[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] += 1
    discounts = {}
    for n in range(1, order + 1):
        k = collections.Counter(min(c, 5) for c in counts[n].values())
        n1, n2, n3, n4 = (max(1, k[i]) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discounts[n] = [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    followers = [collections.defaultdict(list) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            followers[n][g[:-1]].append(c)

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (len(counts[1]) + 1)
        seen, d = followers[n].get(gram[:-1]), discounts[n]
        if not seen:
            return p(gram[1:])
        c, total = counts[n][gram], sum(seen)
        cut = lambda c: d[min(c, 3) - 1]
        return (c - cut(c) if c else 0) / total + sum(map(cut, seen)) / total * p(gram[1:])

    return lambda t: sum(np.log(p(tuple(([1] * (order - 1) + [ord(c) for c in t])[i : i + order]))) for i in range(len(t)))


def test_kneser_ney_equals_the_textbook(spark):
    """All scripts, blocks of any size and any number of shards, to the precision of doubles."""
    train = ["the cat sat on the mat", "the dog sat on a log", "a cat and a dog", "zebra", "नमस्ते दुनिया", "猫が座った 犬が座った"]
    probe = [(1, "the cat"), (2, "xyz the mat"), (3, None), (4, "a dog on"), (4, "a dog on"), (None, "é"), (7, "दुनिया 猫が"), (8, "🙂 мир"), (9, "")]
    scratch = Scratch(spark, "kn")
    model = kneser_ney.estimate(kneser_ney.count(edge(spark, list(enumerate(train))), 3), scratch, 3)
    want = brute_kneser_ney(train, 3)
    docs = edge(spark, probe)
    for options in ({}, {"block": 10, "shard_keys": 7}):
        got = sorted((r.doc_id or 0, r.lm_chars, r.lm_log_p) for r in kneser_ney.score(docs, *model, **options).collect())
        for (i, t), (j, n, lp) in zip(sorted(((i or 0, t or "") for i, t in probe)), got):
            assert (i, len(t)) == (j, n) and abs(lp - want(t)) < 1e-9
    assert kneser_ney.score(docs.limit(0), *model).count() == 0


def test_thresholds_by_hand(spark):
    """Perplexities drawn to the trusted mean, thresholds from their quantiles, also with columns of clashing names."""
    rows = [(i, "abc " * 30 + "xy" * i, "en" if i % 2 else None) for i in range(12)] + [(20, "q#" * 200, "en"), (21, "", "de"), (22, "abc " * 9, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("lm_chars", "_trusted", "limit", "trusted_id", "lm_trusted", "block", "h")})
    trusted = spark.createDataFrame([(i,) for i in range(12)], "doc_id long")
    scratch = Scratch(spark, "kn")
    good = docs.where("doc_id < 12")
    model = kneser_ney.estimate(kneser_ney.count(good, 3), scratch, 3)
    lp = {r.doc_id: (r.lm_log_p, len(r.text)) for r in kneser_ney.score(docs.select("doc_id", "text"), *model, keep_text=True).collect()}
    mean = sum(lp[i][0] for i in range(12)) / sum(lp[i][1] for i in range(12))
    ppl = {i: np.exp(-(a + 200 * mean) / (n + 200)) if n else None for i, (a, n) in lp.items()}
    out = {r.doc_id: r for r in kneser_ney.judge(docs, trusted, order=3, quantile=0.5).collect()}
    for i, r in out.items():
        same = sorted(ppl[j] for j in range(12) if j % 2 == (r.lang == "en")) if r.lang != "de" else sorted(ppl[j] for j in range(12))
        limit = 1.12 * same[-(-len(same) // 2) - 1]
        assert abs(r.lm_threshold - limit) < 1e-9 and r.lm_kept == (ppl[i] is not None and ppl[i] <= limit) and r._trusted == r.block == "x"
    assert not out[20].lm_kept and not out[21].lm_kept


def test_kneser_ney_query_and_edges(spark):
    got = queries.op9_kneser_ney(spark, SF2)
    labelled = got.join(spark.read.parquet(f"{SF2}/labels.parquet"), "doc_id")
    assert got.count() == 1000
    assert labelled.where("quality = 1 and not kept").count() == 0
    assert labelled.where("quality = 0 and kept").count() < 0.15 * labelled.where("quality = 0").count()
    docs = edge(spark).withColumn("lang", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "doc_id long")
    out = {r.doc_id: r.lm_kept for r in kneser_ney.judge(docs, none).collect()}
    assert len(out) == len(EDGE) and out[1] is False and out[2] is False and out[4] is True


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in queries.op7_html_text(spark, SF).join(pages.select("page_id", "html"), "page_id").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        import html

        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", lambda m: " " * (m[0] == "<br>"), b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


def test_main_text_without_article_and_edges(spark):
    page = '<body><div class="menu"><a href=x>Home</a></div><div id="content"><h1>Title &amp; x</h1><p>First para text here, long enough.<p>Second <i>para</i>graph is <a href=y>linked</a>&nbsp;too.<ul><li>one<li>two</ul></div><div class="comments"><p>reader says hi and more and more text</p></div><footer>Copyright</footer><form><p>mail</p></form>'
    assert html_text.main_text(page) == "Title & x\nFirst para text here, long enough.\nSecond paragraph is linked too.\none\ntwo"
    nested = "<article><header><h1>T</h1></header><p>Body <script>x('</p>')</script>text</p><aside>no</aside><section class='comment-list'><article>me too</article></section></article>"
    assert html_text.main_text(nested) == "T\nBody text"
    for odd in ("", "<", "<p", "</p></div>", "<!-- open", "<script>x", "a &lt; b", "<td>x<tr><td>y", "<li>" * 3000 + "deep" , "<div>" * 3000 + "deep"):
        assert isinstance(html_text.main_text(odd), str)
    rows = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>"), (1, None, None)], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract(rows).collect()) == [(0, "x"), (1, ""), (1, "")]


def test_density_chooses_the_text(monkeypatch):
    """Densities of zero change the result; names in the text are kept, marked containers aren't; time is linear."""
    words = "some words of the text that go on for a while, as texts do. "
    menu = "".join(f"<a href=/{i}>item {i}</a> " for i in range(30))
    page = f"<body><div>{menu}</div><div><h1>Title</h1><section><p>{words * 4}</p><h2 id='related-work'>Related</h2><p class='notice-board'>{words}</p></section><section><p>{words * 3}</p></section></div></body>"
    want = "\n".join(["Title", (words * 4).strip(), "Related", words.strip(), (words * 3).strip()])
    assert html_text.main_text(page) == want
    two = f"<article><p>{words}</p></article><article><h2>Other</h2><p>{words * 5}</p><div class='ad-slot'>buy</div></article>"
    assert html_text.main_text(two) == f"Other\n{(words * 5).strip()}"
    for long in ("<div>" * 20_000 + "</p>" * 20_000, "<b>" * 20_000 + "<div>x</div>" * 20_000):
        began = time.process_time()
        html_text.main_text(long)
        assert time.process_time() - began < 3
    monkeypatch.setattr(html_text, "density", lambda node, body: 0.0)
    assert html_text.main_text(page) != want


def test_pages_empty_and_clashing(spark):
    rows = spark.createDataFrame([(1, "u", "<p>x</p>", "t", 7)], "page_id long, url string, html string, text string, n_chars int")
    assert [(r.text, r.n_chars) for r in html_text.extract(rows).collect()] == [("x", 1)]
    assert html_text.extract(rows.limit(0)).count() == 0


def test_near_duplicates_keeps_different_texts_of_one_id(spark):
    rows = [(1, "one two three four five six seven"), (1, "quite another text that shares nothing at all"), (2, "one two three four five six seven"), (1, "one two three four five six seven"), (None, "one two three four five six seven"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own_hash", F.lit(1))
    got = corpus_pipeline.near_duplicates(spark, docs, SF2)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted((i or 0, t or "") for i, t in [rows[0], rows[1], rows[4], rows[5]])


def test_short_sections_and_named_paragraphs_stay():
    long = "<p>" + "A sentence of the article that carries its text along. " * 6 + "</p>"
    page = f"<body><div class='top'><a href=1>Home</a> <a href=2>News</a></div><div id=content><section><h2>First</h2>{long}</section><section><h2>Second</h2>{long}</section><section><h2>Third</h2><p>tiny.</p></section></div></body>"
    text = html_text.main_text(page).split("\n")
    assert [t for t in text if len(t) < 20] == ["First", "Second", "Third", "tiny."] and len(text) == 6
    assert html_text.main_text(page.replace("<div id=content>", "<article>").replace("</section></div>", "</section></article>")) == "\n".join(text)
    named = f"<body><article>{long}<p class='search'>How the search went.</p><p class='social'>A social matter.</p><div class='social'>Follow us</div><p class='advert'>Buy now</p></article></body>"
    assert html_text.main_text(named).split("\n")[1:] == ["How the search went.", "A social matter."]


def test_only_density_tells_text_from_links(monkeypatch):
    """Pages without a telling name or tag: link lists before, beside and after the text, of more characters than it."""
    words = "Plain words make up this sentence of the story, and more of them follow it. "
    links = "".join(f"<div><a href='{i}'>A longer headline of another story number {i}</a></div>" for i in range(60))
    for order in ("{links}{text}", "{text}{links}", "{links}{text}{links}"):
        body = order.format(links=f"<div class='c1'>{links}</div>", text=f"<div class='c2'><h1>Story</h1><p>{words * 4}</p><p>{words * 3}</p><p>Short end.</p></div>")
        page = f"<body><div class='c0'>{body}</div></body>"
        want = f"Story\n{(words * 4).strip()}\n{(words * 3).strip()}\nShort end."
        assert html_text.main_text(page) == want
        with monkeypatch.context() as without:
            without.setattr(html_text, "density", lambda node, body: 0.0)
            assert html_text.main_text(page) != want
