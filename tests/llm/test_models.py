"""Classifiers, page model, graph search and mixing: beside brute force and held-out rows."""

from __future__ import annotations

import html
import itertools
import math
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import cotraining, graph_index, html_blocks, mixing, page_crf, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def labels_of(column):
    return dict(duckdb.sql(f"select doc_id, {column} from '{FOLDER}/labels.parquet'").fetchall())


# -- Toxicity ------------------------------------------------------------------------------


def test_the_grammar_marks_attacks():
    lexicon = toxicity.Lexicon({"idiot": 4.0}, {"moro": 3.0})

    def kinds(text):
        return [m for clause in lexicon.symbols(toxicity.tokens(text)) for m in toxicity.clause_matches(clause)]

    assert kinds("an idiot walks") == [("plain", 4.0)]
    assert kinds("you are an idiot") == kinds("idiot that you are") == [("aimed", 4.0)]
    assert kinds("you are not an idiot") == [("denied", 4.0)]
    assert kinds("not one of the many clever idiot things") == [("plain", 4.0)]
    assert kinds("she said you idiot") == [("reported", 4.0)]
    assert kinds("you. an idiot") == [("plain", 4.0)]
    assert kinds("they will kill you, moronic") == [("aimed_threat", 1.0), ("aimed", 3.0)]
    assert kinds("nothing of that kind") == []
    # Words on no path, alone, or in a command to no person.
    assert kinds("Kill the process, then burn the disc.") == [] and kinds("idiot") == kinds('"idiot!"') == []
    assert kinds("he will burn the disc") == kinds("will you kill the process?") == kinds("you should burn the disc") == []
    # Reports behind an attack, across a colon, in quotes and after them; reporters are no targets.
    assert kinds("an idiot, he said") == kinds("he said: you idiot") == kinds('so "you are an idiot" it went') == [("reported", 4.0)]
    assert kinds('he said "go on", you idiot') == kinds('you idiot, "go on" he said') == [("aimed", 4.0)]
    assert kinds('"Go on. You idiot. Now" he said') == [("reported", 4.0)]
    assert kinds('a 5" disc, you idiot') == [("aimed", 4.0)]
    assert kinds("note: you idiot") == [("aimed", 4.0)]
    assert kinds("you read a long word and then one more about some idiot") == [("plain", 4.0)]
    # Paths of threats.
    assert kinds("kill them") == kinds("ich werde dich töten") == kinds("we are going to hurt you") == [("aimed_threat", 1.0)]
    assert kinds("I hope you burn") == kinds("you should hang") == kinds("hope they burn in hell") == [("threat", 1.0)]
    assert kinds("I will not kill you") == [("denied", 1.0)] and kinds("she said they will kill you") == [("reported", 1.0)]


def brute_kinds(s):
    """Kinds of the attacks of a clause without quotes, from the places of its symbols."""

    def beside(i):
        return any(0 <= j < len(s) and s[j] == "REPORT" for j in (i - 1, i + 1))

    target = [x in ("TARGET", "OWNER") and not beside(i) for i, x in enumerate(s)]
    person = [target[i] and x == "TARGET" for i, x in enumerate(s)]
    leads = ("MODAL", "FUTURE", "WISH", "OUGHT")
    out = []
    for i, x in enumerate(s):
        if x not in ("INSULT", "THREAT") or len(s) < 2:
            continue
        kind = "aimed" if any(target[max(0, i - toxicity.REACH):i + toxicity.REACH + 1]) else "plain"
        if x == "THREAT":
            # A lead reaches over words, up to the next lead or verb.
            back = [j for j in range(i) if s[j] in (*leads, "THREAT")]
            j = back[-1] if back and s[back[-1]] in leads and i - back[-1] <= toxicity.LEAD else None
            between = j is not None and any(person[j + 1:i])
            behind = any(person[i + 1:i + 1 + toxicity.OBJECT])
            modal = j is not None and s[j] != "WISH" and (behind or s[j] == "FUTURE" and between)
            command = i == 0 and person[1]
            ends = i + 1 == len(s) or s[i + 1] == "INTO"
            wish = j is not None and (
                s[j] == "WISH" and between or s[j] == "OUGHT" and (between or j > 0 and person[j - 1])
            )
            if not (modal or command or wish and ends):
                continue
            kind = "aimed_threat" if modal or command else "threat"
        if any(r == "REPORT" and (j < i or len(s) - 1 - j <= toxicity.BEHIND) for j, r in enumerate(s)):
            kind = "reported"
        if "NEG" in s[max(0, i - toxicity.SCOPE):i]:
            kind = "denied"
        out.append(kind)
    return out


def test_the_grammar_equals_brute_force_over_short_clauses():
    alphabet = "INSULT THREAT TARGET OWNER NEG REPORT MODAL OUGHT FUTURE WISH INTO OTHER".split()
    draw = np.random.default_rng(3)
    clauses = [c for n in range(1, 5) for c in itertools.product(alphabet, repeat=n)]
    clauses += [tuple(draw.choice(alphabet, int(draw.integers(5, 14)))) for _ in range(20_000)]
    for clause in clauses:
        assert [k for k, _ in toxicity.clause_matches([(s, 1.0) for s in clause])] == brute_kinds(clause), clause


def test_toxic_documents_are_found_among_held_out_rows(spark):
    truth = labels_of("toxic")
    rows = queries.op8_clause_toxicity(spark, FOLDER).collect()
    assert len(rows) == duckdb.sql(f"select count(*) from '{FOLDER}/documents.parquet'").fetchall()[0][0]
    held = [(truth[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in truth]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(t == p for t, p, _ in held) >= 0.95 * len(held)


def test_scores_see_the_text_only(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    base = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    other = docs.select((F.col("doc_id") + 0).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("s").alias("source"))
    assert {r.doc_id: r.score for r in toxicity.scored(other, labels).collect()} == base
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn(
        "toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    assert {r.doc_id: r.score for r in toxicity.scored(docs, flipped).collect()} == base


def test_toxicity_of_awkward_rows(spark, awkward, awkward_rows, nothing):
    labels = spark.createDataFrame([(0, 1), (1, 1), (7, 0), (8, 0), (99, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.scored(awkward, labels).collect()
    assert len(rows) == len(awkward_rows) and all(0 <= r.score <= 1 for r in rows)
    assert next(r for r in rows if r.doc_id is None).held_out is False
    assert {r.score for r in toxicity.scored(awkward, labels.where("false")).collect()} == {0.0}
    assert toxicity.scored(nothing, labels).count() == 0


# -- Quality -------------------------------------------------------------------------------


def test_quality_agrees_with_labels_that_were_not_used(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    used = labels.where("doc_id % 3 != 0")
    truth = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    rows = cotraining.scored(docs, used).collect()
    assert len(rows) == docs.count()
    tested = [(truth[r.doc_id], r.keep) for r in rows if r.doc_id in truth]
    assert sum(a == b for a, b in tested) >= 0.95 * len(tested)
    good = [b for a, b in tested if a == 1]
    assert sum(good) >= 0.97 * len(good)


def test_views_teach_each_other():
    """Where labels are few, the surest documents of one view train the other."""
    draw = np.random.default_rng(5)
    assert len(cotraining.content("A word. Another one!\nline")) == len(cotraining.CONTENT)
    assert cotraining.content("") == [0.0] * len(cotraining.CONTENT)
    assert cotraining.metadata(None, None, None) == [-1.0, -1.0, -1.0]
    x = draw.normal(size=(400, 2))
    y = (x[:, 0] + 0.1 * draw.normal(size=400) > 0).astype(float)
    view = cotraining.View.over(x, exact=False)
    view.fit(x, y, np.ones(400))
    assert ((view.logit(x) > 0) == y).mean() > 0.9


def test_quality_of_awkward_rows(spark, awkward, awkward_rows, nothing):
    labels = spark.createDataFrame([(0, 1), (1, 1), (7, 0), (8, 0), (15, 1), (99, 1), (5, None)], "doc_id long, quality int")
    rows = cotraining.scored(awkward, labels).collect()
    assert len(rows) == len(awkward_rows) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in cotraining.scored(awkward, labels.where("false")).collect()} == {1.0}
    assert cotraining.kept(awkward, labels.where("false")).count() == len(awkward_rows)
    assert cotraining.kept(awkward, labels).columns == awkward.columns
    assert cotraining.scored(nothing, labels).count() == 0


# -- Pages ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def field():
    return page_crf.trained(300)


def test_held_out_layouts_are_read_right(field):
    wrong = total = 0
    for seed in range(50_000, 50_150):
        source, labels = page_crf.labelled_page(seed)
        found = html_blocks.blocks(source)
        assert len(found) == len(labels)
        wrong += sum(a != b for a, b in zip(field.decoded(html_blocks.described(found)), labels, strict=True))
        total += len(labels)
    assert wrong <= 0.01 * total


def test_given_pages_give_their_articles(spark):
    rows = {r.page_id: r for r in queries.op9_main_text(spark, FOLDER).collect()}
    pages = duckdb.sql(f"select page_id, url, html from '{FOLDER}/pages.parquet'").fetchall()
    assert len(rows) == len(pages)
    for page_id, url, source in pages:
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert rows[page_id].text == "\n".join(p for p in parts if p)
        assert (rows[page_id].url, rows[page_id].n_chars) == (url, len(rows[page_id].text))


def test_decoding_finds_the_best_sequence():
    draw = np.random.default_rng(1)
    field = page_crf.Field(draw.normal(size=(2, 6)), draw.normal(size=(2, 2)))
    rows = [sorted(draw.choice(6, size=2, replace=False).tolist()) for _ in range(7)]

    def value(labels):
        own = sum(field.emission[k, r].sum() for k, r in zip(labels, rows, strict=True))
        return own + sum(field.step[a, b] for a, b in zip(labels, labels[1:], strict=False))

    every = [[i >> t & 1 for t in range(7)] for i in range(128)]
    assert value(field.decoded(rows)) == pytest.approx(max(map(value, every)))


def test_a_page_with_everything_around_the_article(field):
    source = """<html><head><title>T</title><style>p{}</style></head><body>
    <div id="cookie-banner"><p>We use cookies. Accept?</p><button>OK</button></div>
    <header class="site"><a href=/>Site</a><p>Tagline of the site.</p></header>
    <nav class="main-nav"><a href=/a>Home</a> | <a href=/b>News</a></nav>
    <aside class="sidebar"><h3>Popular</h3><ul><li><a href=/x>Some link</a></li></ul></aside>
    <article><h1>The&nbsp;title</h1><p>First <i>para</i>graph,\n with <a href=x>a link</a> &amp; words.<p>Second &lt;b&gt; one.
    <div class="ad-slot">Buy things now.</div><ul><li>Point one<li>Point two</ul>
    <form><label>Email</label><input><button>Subscribe</button></form></article>
    <section id="comments"><h2>3 comments</h2><div class="comment"><p>I disagree, says a reader.</p></div></section>
    <footer><p>Copyright 2024.</p></footer><script>var x = "<p>no</p>";</script></body></html>"""
    assert page_crf.main_text(source, field) == (
        "The title\nFirst paragraph, with a link & words.\nSecond <b> one.\nPoint one\nPoint two"
    )


@pytest.mark.parametrize(
    "source", ["<p a='" * 30_000, "<" * 200_000, "<div>" * 5_000 + "x", "<!--" * 30_000, "<a " + "x" * 300_000,
               "</p>" * 50_000, "<div>" * 20_000 + "</p>" * 20_000, "<script>" + "<p>" * 50_000, "&" * 100_000]
)
def test_broken_pages_are_read_in_bounded_time(field, source):
    page_crf.main_text(source, field)


def test_awkward_pages(spark, field):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p>One para, a sentence of words.</p>", "x"), (None, "u", "  ", "x"),
            (3, "u", "<p>One para, a sentence of words.</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = page_crf.extracted(pages, field).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter(
        [(1, ""), (2, ""), (3, "One para, a sentence of words."), (3, "One para, a sentence of words."), (None, "")]
    )
    assert page_crf.extracted(pages.where("false"), field).count() == 0


# -- Neighbours ----------------------------------------------------------------------------


def brute_nearest(rows, k, every):
    seen = {(i, tuple(v)) for i, v in rows}
    out = {}
    for q, v in seen:
        if q % every == 0:
            scores = [(-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in seen if i != q]
            out[q] = sorted(scores)[:k]
    return out


def test_recall_and_scores_over_the_given_vectors(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{FOLDER}/embeddings.parquet'").fetchall()
    expected = brute_nearest(rows, 20, 20)
    got = defaultdict(list)
    for r in queries.op7_graph_neighbours(spark, FOLDER).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(expected)
    vectors = dict(rows)
    hits = 0
    for q, answers in got.items():
        assert [a[0] for a in answers] == list(range(1, 21))
        for _, i, score in answers:
            assert score == pytest.approx(np.dot(np.float64(vectors[q]), np.float64(vectors[i])), abs=1e-12)
        assert [a[1] for a in answers] == [i for _, i in sorted((-s, i) for _, i, s in answers)]
        hits += len({a[1] for a in answers} & {i for _, i in expected[q]})
    assert hits >= 0.95 * 20 * len(expected)


def test_recall_over_several_shards_with_many_copies(spark):
    draw = np.random.default_rng(2)
    points = draw.normal(size=(1500, 16)) * draw.uniform(0.5, 2, size=(1500, 1))
    points[400:900] = points[3]
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    expected = brute_nearest(rows, 10, 50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in graph_index.nearest(df, k=10, every=50, shard_vectors=300).collect():
        got[r.query_id].add(r.vec_id)
    found = sum(len(got[q] & {i for _, i in e}) for q, e in expected.items())
    assert found >= 0.95 * sum(len(e) for e in expected.values())


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [1.0, None]), (8, [1.0]), (20, [0.0, -2.0]), (20, [0.0, -2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in graph_index.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, -1.0)]
    assert graph_index.nearest(df.where("false")).count() == 0
    one = graph_index.nearest(df.where("vec_id = 0"))
    assert one.count() == 0


# -- Mixing --------------------------------------------------------------------------------


def tokens_by(rows, *names):
    out = Counter()
    for r in rows:
        out[tuple(r[n] for n in names)] += r.tokens
    return out


def entropy(p, a):
    w = [x**a for x in p]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)


@pytest.fixture(scope="module")
def uneven(spark):
    rows = [(i, "w " * (20 + i % 7), "big" if i < 700 else "mid" if i < 900 else "low", "en") for i in range(1000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_no_document_is_lost_and_none_repeated_beyond_the_limit(uneven):
    rows = mixing.mixed(uneven, max_repeats=3.0, block_tokens=500).collect()
    times = Counter(r.doc_id for r in rows)
    assert set(times) == set(range(1000)) and max(times.values()) <= 3
    total = {s: sum(20 + i % 7 for i in r) for s, r in (("big", range(700)), ("mid", range(700, 900)), ("low", range(900, 1000)))}
    used = tokens_by(rows, "source")
    p = {s: t / sum(total.values()) for s, t in total.items()}
    # The limit is met by the smallest source: (p_big / p_low) ** (1 - a) = 3.
    a = 1 - math.log(3) / math.log(p["big"] / p["low"])
    z = sum(x**a for x in p.values())
    for s in total:
        assert used[s,] / sum(used.values()) == pytest.approx(p[s] ** a / z, abs=0.005)
        assert next(r.weight for r in rows if r.source == s) == pytest.approx(p[s] ** a / z, rel=1e-6)


def test_entropy_target_and_budget(uneven):
    rows = mixing.mixed(uneven, budget=15_000, max_repeats=None, target_entropy=0.9, block_tokens=500).collect()
    weights = {r.source: r.weight for r in rows}
    h = -sum(w * math.log(w) for w in weights.values())
    assert h == pytest.approx(0.9 * math.log(3), abs=1e-6)
    used = tokens_by(rows, "source")
    for s, w in weights.items():
        assert 0 <= round(w * 15_000) - used[s,] <= 27


def test_epochs_are_whole_permutations_of_blocks(uneven):
    rows = mixing.mixed(uneven, max_repeats=3.0, block_tokens=500).collect()
    by = defaultdict(set)
    order = defaultdict(dict)
    for r in rows:
        by[r.source, r.epoch].add(r.doc_id)
        order[r.source, r.epoch][r.block] = r.block_order
    assert by["low", 1] == by["low", 2] == set(range(900, 1000))
    ranks = [sorted(order["low", e], key=order["low", e].get) for e in (1, 2)]
    assert sorted(ranks[0]) == sorted(ranks[1]) and ranks[0] != ranks[1]
    # A last epoch that is not whole takes blocks from the front of its order.
    last = max(e for s, e in by if s == "mid")
    blocks = defaultdict(set)
    for r in rows:
        if r.source == "mid" and r.epoch == 1:
            blocks[r.block].add(r.doc_id)
    part = [b for b in sorted(order["mid", last], key=order["mid", last].get)]
    assert all(blocks[b] <= by["mid", last] for b in part[:-1])


def test_mixing_of_awkward_rows(awkward, awkward_rows, nothing):
    out = mixing.mixed(awkward)
    assert out.columns == [*awkward.columns, "tokens", "weight", "epoch", "block", "block_order", "doc_order"]
    rows = out.collect()
    with_words = {i for i, t, *_ in awkward_rows if t and t.split()}
    assert with_words <= {r.doc_id for r in rows}
    assert mixing.mixed(nothing).count() == 0
    assert mixing.mixed(awkward.where("text is null")).count() == 0
    one = mixing.mixed(awkward.where("source = 's0'")).collect()
    assert len(one) == sum(s == "s0" for *_, s, _, _, _, _ in awkward_rows)


def test_given_documents_are_mixed_whole(spark):
    rows = queries.op10_temperature_mixture(spark, FOLDER).collect()
    ids = {i for (i,) in duckdb.sql(f"select doc_id from '{FOLDER}/documents.parquet'").fetchall()}
    assert {r.doc_id for r in rows} == ids


# -- Findings of the second round ------------------------------------------------------------


def test_copies_of_a_toxic_text_hide_no_insult(spark):
    draw = np.random.default_rng(5)
    insults = [f"{c}nsult" for c in "abcdefghij"]

    def text(extra):
        words = ["".join(chr(97 + c) for c in draw.integers(0, 8, 4)) for _ in range(60)]
        for w in extra:
            words.insert(int(draw.integers(1, len(words))), w)
        return " ".join(words)

    rows = [(text(draw.choice(insults, 4, replace=False)), 1) for _ in range(100)] + [(text([]), 0) for _ in range(300)]
    rows += [(text(insults), 1)] * 200
    lexicon = toxicity.learned_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert all(lexicon.read(w) and lexicon.read(w)[0] == "INSULT" for w in insults)


def test_open_hidden_elements_end_where_browsers_end_them():
    def texts(source):
        return [b.text for b in html_blocks.blocks(source)]

    assert texts("<html><head><title>t</title><meta charset=x><body><p>one<p>two") == ["one", "two"]
    assert texts("<head><title>t</title><link rel=x><div>one</div><p>two</p>") == ["one", "two"]
    assert texts("<head><title>t</title>\n text <p>two</p>") == ["text", "two"]
    for tag in ("select", "svg", "object"):
        assert texts(f"<body><div><{tag}>inside<p>one</p><p>two</p></div>") == ["one", "two"]
        assert texts(f"<body><div><{tag}>in<p>side</p></{tag}><p>one</p></div>") == ["one"]
    block = html_blocks.blocks("<body><nav>" + "<b>" * 100 + "menu")[0]
    assert [tag for tag, _ in block.path] == ["body", "nav"]


def test_quoted_values_and_formulas_of_any_length_are_read():
    def texts(source):
        return [b.text for b in html_blocks.blocks(source)]

    long = "y" * 4001
    assert texts(f'<p data-x="{long}>leak">two') == ["two"]
    assert texts("<p data-x='" + "y>" * 4200 + "'>two") == ["two"]
    assert texts('<p title="open>one</p><p>two</p>') == ["one", "two"]
    assert texts("<p>1 < 2 <b and 3 > 2</p>") == ["1 < 2 2"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p>") == ["so x=2 holds"]
    deep = html_blocks.blocks("<nav>" + "<div>" * 300 + "menu")[0]
    assert [t for t, _ in deep.path[:2]] == ["nav", "div"] and len(deep.path) == 301
    assert html_blocks.INDEX["in nav"] in html_blocks.described([deep])[0]


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<b>" * n + "<hr>" * n, lambda n: "<iframe>" * n, lambda n: "<textarea>" * n,
        lambda n: "<span><td>" * n, lambda n: "<div class=nav>x" * n, lambda n: "<div>" * n + "<p>x</p>" * n,
        lambda n: "<a \"'>" * n, lambda n: "<a '\"<" * n, lambda n: "<li><b>" * n,
    ],
)
def test_time_is_linear_in_the_page(page):
    def seconds(n):
        source, start = page(n), time.process_time()
        html_blocks.described(html_blocks.blocks(source))
        return time.process_time() - start

    # Ten times the page; a quadratic walk would take a hundred times as long.
    assert seconds(100_000) < 30 * max(seconds(10_000), 0.02)


def test_the_end_of_a_budget_equals_a_walk_over_all_blocks(spark, uneven):
    """Where the last epoch ends, by plain sums over each source's blocks and documents."""
    rows = uneven.withColumns({"tokens": mixing.tokens(F.col("text")), "doc_key": F.xxhash64("doc_id")}).select(
        "source", "tokens", "doc_key"
    )
    planned = mixing.plan(rows, budget=14_321, max_repeats=None, target_entropy=0.9, block_tokens=40).collect()
    order = {}
    for p in planned:
        keyed = rows.where(F.col("source") == p.source).withColumn("block", mixing.block_of(F.col("doc_key"), F.lit(p.blocks)))
        keyed = keyed.withColumn("order", mixing.block_order(F.lit(42), F.col("source"), F.lit(p.full + 1).cast("long"), F.col("block")))
        order[p.source] = sorted((r.order, r.doc_key, r.tokens) for r in keyed.collect())
    for p in planned:
        left, sizes = p.rest, Counter()
        for block, _, n in order[p.source]:
            sizes[block] += n
        for block in sorted(sizes):
            if sizes[block] > left:
                break
            left -= sizes[block]
        assert (p.last_block, p.room) == (block, left)
        last = None
        for at, key, n in order[p.source]:
            if at == block:
                left -= n
                last = key if left >= 0 else last
        assert p.last_doc == last


def test_mixing_and_quality_keep_the_callers_columns(spark):
    names = ["doc_id", "text", "source", "lang", "n_chars", "__text", "__copies", "share", "numbers", "row"]
    rows = [(i, f"some words {i}", "s", "en", 12, "mine", 7, 0.5, 3, "r") for i in range(4)]
    docs = spark.createDataFrame(rows, names)
    out = mixing.mixed(docs)
    assert out.columns[: len(names)] == names
    assert sorted({tuple(r)[: len(names)] for r in out.collect()}) == rows
    labels = spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, quality int")
    kept = cotraining.kept(docs, labels)
    assert kept.columns == names and sorted(tuple(r) for r in kept.collect()) == rows
