"""HTML extraction and toxicity."""

import random
import zlib

import pytest

from lodeseam.llm import html_extraction as hx
from lodeseam.llm import toxicity as tox

from . import helpers

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>if (a<b) x("</p>")</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use</div><!-- <p>no</p> -->
<div class="ad">Buy</div>{open}<h2>Title &amp; more {i}</h2><p>One <b>bold</b>,<br>two&nbsp;x{i} <p>Text {i}
 goes &#233; on<form><input name=q><p>no</form><aside>no</aside><ul><li>i{i}<li>j{i}</ul><p>Share this</p><section id="comments"><article class="comment">no</article></section>{close}
<div class=sidebar>no</div><footer>&copy; no</footer></body></html>"""


def want(i, templated=True):
    return f"Title & more {i}\n\nOne bold, two x{i}\n\nText {i} goes é on\n\ni{i}\n\nj{i}" + ("" if templated else "\n\nShare this")


@pytest.mark.parametrize(("start", "end"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="story"><div>', "</div></div>")])
def test_extraction_from_templates(spark, tmp_path, start, end):
    rows = [(i, f"http://H.example/{i}", PAGE.format(i=i, open=start, close=end)) for i in range(12)]
    rows += [(100, None, None), (101, "not a url", ""), (102, "http://alone.example/", PAGE.format(i=102, open=start, close=end)[:-30]), (0, "http://h.example/0", rows[0][2])]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, host int, slot string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.url): r for r in hx.op6_html_extraction(spark, str(tmp_path)).collect()}
    assert len(got) == 16
    for (i, _), r in got.items():
        assert r.text == (want(i, r.templated) if i not in (100, 101) else "") and r.n_chars == len(r.text)
        assert r.templated == (i < 100)


def test_slot_and_classes(spark):
    rows = [("h", i, f'<body><div class="x"><a>{"menu " * 9}</a></div><div class="y">{"<p>long text %d</p>" % i * (i + 1)}</div></body>') for i in range(9)]
    r = hx.templates(spark.createDataFrame(rows, "host string, page long, html string")).collect()
    assert [x.slots for x in r] == [["/body/div.y"]] and set(r[0].root) == {"/body", "/body/div.x", "/body/div.y"}
    assert hx.templates(spark.createDataFrame([], "host string, page long, html string")).count() == 0


@pytest.mark.parametrize("page", ["<", "<p", "</p>", "<p>a</b></p>b", "<a title='x>y'>z</a>", "<div " + "x" * 1000, "<b>" * 3000 + "t", "<script>alert(1)", "<!-- open", "a &lt; b &bogus; &#x41;", "<p class=\"un>closed</p>"])
def test_broken_markup_is_read(page):
    assert isinstance(hx.main_blocks(page), list)
    hx.token_stats(page)


def test_blocks_of_broken_markup():
    assert hx.main_blocks("a &lt; b &#x41;<p>c") == ["a < b A", "c"]
    assert hx.main_blocks("<p>a <a title='x>y'>z</a>") == ["a z"]


def test_a_form_around_an_article_is_its_frame():
    article = "<article><h1>T</h1><p>Body text</p></article>"
    assert hx.main_blocks(f"<body><form><input>{article}<button>Send</button></form></body>") == ["T", "Body text"]
    assert hx.main_blocks(f"<body><form><p>Your name</p></form>{article}<form><p>Comment</p></form></body>") == ["T", "Body text"]
    assert hx.main_blocks(f"<body><nav><form>{article}</form></nav><p>kept</p><form><p>open form") == ["kept"]


def test_grammar_scores_clauses():
    lexicon = tox.Lexicon()
    score = lambda t: tox.clause_features(t, lexicon)[0]
    assert score("a plain text.") == 0 == score(None) == score("")
    assert score("You are an idiot.") > score("An idiot.") > 5 * score("You are not an idiot.") > 0
    assert score("He said that you are an idiot.") < 0.5 * score("You are an idiot")
    assert score("not here. An idiot") == score("An idiot")
    assert score("I will kill you") > score("kill the lights") > 0
    assert score("An idiot, a moron") > score("An idiot") + score("A moron")  # repetition completes
    assert score("An idiot is what you are") > score("An idiot")
    model = tox.Model({}, {}, tox.DEFAULT)
    assert [model.score(tox.clause_features(t, lexicon)) >= 0.7 for t in ("You are an idiot", "I will kill you", "An idiot", "kill the lights", "You are not an idiot")] == [True, True, False, False, False]


def brute_features(text, lexicon):
    """Clause by clause, by counting words instead of states."""
    clauses, now = [], []
    for w in tox._TOKEN.findall((text or "").lower()):
        if w in ".!?;\n":
            clauses.append(now)
            now = []
        else:
            now.append(lexicon.look(w))
    scores = []
    for words in [*clauses, now]:
        total, targets, insults, threats, reported, denied, complete = 0.0, 0, 0, 0, False, -9, False
        for i, (kind, weight) in enumerate(words):
            if kind == "report":
                reported = True
            elif kind == "negation":
                denied = denied if reported else i
            elif kind in ("insult", "threat") and (reported or i - denied <= 3):
                total += weight * (0.1 if reported else 0.05)
            elif kind == "insult":
                whole = targets or insults or threats
                total += weight * (1 if whole else tox.PARTIAL)
                complete, insults = complete or bool(whole), insults + 1
            elif kind == "threat":
                whole = targets or insults or complete
                total += weight * (1 if whole else 0.1)
                complete, threats = complete or bool(whole), threats + 1
            elif kind == "target":
                if not complete and (insults or threats):
                    total += tox.COMPLETES if insults else tox.THREATENS
                    complete = True
                targets += not (insults or threats)
        scores.append(total)
    return max(scores), sum(scores)


def test_scores_against_a_brute_force_scorer():
    rng = random.Random(6)
    lexicon = tox.Lexicon({"zorp": 6.0}, {"blem": 3.0})
    words = ["idiot", "zorp", "blemish", "kill", "you", "he", "not", "never", "said", "tree", "green", "house", ".", "!", "\n", "stone"]
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        assert tox.clause_features(text, lexicon) == pytest.approx(brute_features(text, lexicon)), text


def test_grammar_beats_its_bag_of_words_on_negated_and_reported_speech():
    rng = random.Random(7)
    lexicon, model = tox.Lexicon(), tox.Model({}, {}, tox.DEFAULT)
    insults = tox.SEEDS["insult"].split()[:12]
    toxic = [f"{rng.choice(['you are', 'she is', 'they are all'])} a {x}" for x in insults for _ in range(5)]
    clean = [t.format(x) for x in insults for t in ("she is not a {}", "he said that you are a {}", "nobody is a {} here", "they never were {}", "the paper quoted the word {}")]
    by_grammar = [model.score(tox.clause_features(t, lexicon)) for t in toxic + clean]
    bag = [sum(lexicon.look(w)[1] for w in t.split() if lexicon.look(w)[0] == "insult") for t in toxic + clean]
    y = [1] * len(toxic) + [0] * len(clean)
    right = lambda scores, limit: sum((s >= limit) == bool(k) for s, k in zip(scores, y, strict=True)) / len(y)
    assert right(by_grammar, 0.7) >= 0.95 > 0.6 > max(right(bag, limit) for limit in sorted(set(bag)))


def test_fitted_coefficients_never_lower_a_score():
    import numpy as np

    rng = np.random.default_rng(3)
    total = rng.uniform(0, 40, 600)
    best = np.where(total > 12, total * rng.uniform(0.05, 0.3, 600), total * rng.uniform(0.5, 1, 600))  # many weak matches are toxic, one strong is not
    fitted = tox.fit_logistic(np.column_stack([best, total]), (total > 12).astype(float), np.ones(600))
    assert min(fitted[1:]) >= tox.LEAST_COEFFICIENT and fitted[2] > 2


def test_composition_equals_one_after_the_other():
    rng = random.Random(1)
    a, b = tox.scope(), tox.clause()
    for _ in range(200):
        x = y = 0
        z = tox.GRAMMAR.start
        for _ in range(12):
            symbol = rng.choice(tox.CLASSES)
            x, out, w1 = a.step(x, symbol)
            y, out, w2 = b.step(y, out)
            z, whole, w = tox.GRAMMAR.step(z, symbol)
            assert (whole, w, z) == (out, w1 * w2, x * b.states + y)


def learnable(n=900, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiouklmn") for _ in range(rng.randint(3, 6)))
    common = [word() for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), "zorp" + rng.choice(["en", "ig", "um", "as", "ott"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_query(spark, tmp_path):
    rows, labels = learnable()
    docs = helpers.docs(spark, rows).unionByName(helpers.odd(spark).selectExpr("doc_id + 5000 AS doc_id", "text", "lang", "source", "n_chars"))
    folder = helpers.save(helpers.wide(docs), tmp_path)
    odd_labels = [(3, 1, 1 - labels[3][2]), (4, 1, None), (None, 1, 1)]
    helpers.save(spark.createDataFrame(labels + odd_labels, "doc_id long, quality int, toxic int"), folder, "labels")
    got = tox.op7_toxicity(spark, folder).collect()
    assert len(got) == len(rows) + 11
    truth = {i: t for i, _, t in labels}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert len(right) > 200 and sum(right) >= 0.97 * len(right)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_toxicity_without_labels(spark):
    docs = helpers.docs(spark, [(1, "You are an idiot, a moron."), (2, "fine"), (3, None)])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.learn(docs, labels)
    assert {r.doc_id: r.predicted for r in tox.score_documents(docs, model).collect()} == {1: 1, 2: 0, 3: 0}
    assert sorted(r.doc_id for r in tox.drop_toxic(helpers.wide(docs), model).collect()) == [2, 3]
    assert tox.score_documents(helpers.docs(spark, []), model).count() == 0


def test_labels_of_held_out_rows_play_no_part(spark):
    rows, labels = learnable(300)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    docs = helpers.docs(spark, rows)
    a, b = (tox.learn(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert a.learned == b.learned and a.stems == b.stems and a.coefficients == pytest.approx(b.coefficients, abs=1e-6)


def texts_of(spark, page, n=8):
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(n)]
    return [r.text for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_all_parts_of_the_main_text_are_extracted(spark):
    word = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    page = lambda i: f'<body><div class="top">Our site</div><div class="wrap"><h1>Title {i}</h1><div class="intro">{word(i, 20)}</div><div class="body">{word(-i, 80)}</div></div></body>'
    assert texts_of(spark, page) == [f"Title {i}\n\n{word(i, 20)}\n\n{word(-i, 80)}" for i in range(8)]
    page = lambda i: f'<body><p>Our site<article class="a">{word(i, 5)}</article><article class="b">{word(-i, 9)}</article></body>'
    assert texts_of(spark, page) == [f"{word(i, 5)}\n\n{word(-i, 9)}" for i in range(8)]
    assert hx.main_blocks(page(3)) == [word(3, 5), word(-3, 9)]  # without a template


def test_what_every_page_repeats_is_template(spark):
    page = lambda i: f'<body><article><p>Text {i}</p><div class="hint">Read our <b>guide</b></div><p>More {i}</p></article></body>'
    assert texts_of(spark, page) == [f"Text {i}\n\nMore {i}" for i in range(8)]
    assert texts_of(spark, lambda i: page(1)) == ["Text 1\n\nRead our guide\n\nMore 1"] * 8  # pages that are all the same


def words(i, n):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_templates_clean_pages_without_any_listed_name(spark):
    plain = lambda i: f"<body><div><div>Home News</div></div><div><div>{words(i, 12)}</div><div>Subscribe for more of this</div><div>{words(-i, 9)}</div></div><div>All rights reserved by Example</div></body>"
    assert texts_of(spark, plain, 10) == [f"{words(i, 12)}\n\n{words(-i, 9)}" for i in range(10)]
    assert "Home News" in hx.main_blocks(plain(1)) and "All rights reserved by Example" in hx.main_blocks(plain(1))  # what the template does
    article = lambda i: f"<body><article><div>Home / Articles</div><h1>Title {i}</h1><p>{words(i, 20)}</p><p>Terms apply to all of it</p></article></body>"
    assert texts_of(spark, article, 10) == [f"Title {i}\n\n{words(i, 20)}" for i in range(10)]


def test_nested_classes_lie_in_slots_of_the_root(spark):
    notice = '<div class="late"><p>We moved house</p></div>'
    page = lambda i: f"<body><article><h1>Title {i}</h1>{notice if i % 3 else ''}<p>{words(i, 15)}</p></article></body>"
    assert texts_of(spark, page, 12) == [f"Title {i}\n\n{words(i, 15)}" for i in range(12)]
    rows = [("h", i, page(i)) for i in range(12)]
    (r,) = hx.templates(spark.createDataFrame(rows, "host string, page long, html string")).collect()
    assert r.nested >= 3 and "/body/article/div.late" not in r.root and len(r.runs) == 1


def test_article_text_with_unlucky_names_stays(spark):
    odd = '<p class="search-results">Found at last</p><p class="copyright-law">Law text</p><p>Let <math><mi>x</mi></math> be</p><noscript><p>Read on</p></noscript><div class="related work">Earlier work</div>'
    page = lambda i: f"<body><article><h1>Title {i}</h1>{odd if i == 4 else ''}<p>{words(i, 15)}</p></article></body>"
    assert texts_of(spark, page, 10)[4] == f"Title 4\n\nFound at last\n\nLaw text\n\nLet x be\n\nRead on\n\nEarlier work\n\n{words(4, 15)}"


def test_copies_of_pages_keep_their_text(spark):
    page = lambda i: f"<body><article><h1>Title {i % 2 and i}</h1><p>{words(i if i % 2 else 0, 40)}</p></article></body>"
    assert texts_of(spark, page, 20)[::2] == [f"Title 0\n\n{words(0, 40)}"] * 10  # half of the pages are one article
    assert texts_of(spark, lambda i: f"<body><article><h1>N{i}</h1><p>{words(0, 40)}</p></article></body>", 9)[3] == f"N3\n\n{words(0, 40)}"


def test_long_pages_and_empty_tables(spark, tmp_path):
    long = f"<body><article>{''.join(f'<p>{words(k, 30)}</p>' for k in range(3000))}</article></body>"
    rows = [(i, "http://h.example/a", long if i == 2 else f"<body><article><p>{words(i, 9)}</p></article></body>") for i in range(5)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/a/pages.parquet")
    assert {r.page_id: r.n_chars for r in hx.op6_html_extraction(spark, f"{tmp_path}/a").collect()}[2] == sum(len(words(k, 30)) + 2 for k in range(3000)) - 2
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/b/pages.parquet")
    assert hx.op6_html_extraction(spark, f"{tmp_path}/b").count() == 0
