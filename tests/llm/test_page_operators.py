"""HTML extraction, WARC archives, language-model scoring and embedding near-duplicates."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsquorum.llm import html, lm, queries, vectors, warc

# ---- HTML


@pytest.fixture(scope="module")
def field():
    return html.default_field()


def test_held_out_pages(field):
    pages = html.labelled_pages(200, seed=77)
    right = total = whole = 0
    for page, labels in pages:
        got = html.decode(field, html.leaf_blocks(page))
        right, total, whole = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels), whole + (got == labels)
    assert right / total > 0.99 and whole / len(pages) > 0.9


def test_viterbi_equals_all_labellings(field):
    import itertools

    for page, _ in html.labelled_pages(40, seed=5):
        blocks = html.leaf_blocks(page)[:8]
        names = html.features(blocks)
        emit = [[sum(field.weights.get(n, (0, 0))[k] for n in has) for k in (0, 1)] for has in names]
        score = lambda y: field.start[y[0]] + sum(emit[i][v] for i, v in enumerate(y)) + sum(field.moves[a][b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
        assert score(best) == pytest.approx(score([int(x) for x in html.decode(field, blocks)]))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("plain", ["plain"]),
        ("<p>a<p>b<b>c</b> d<br>e", ["a", "bc d e"]),
        ("<p>x &amp;&lt; &#233;&nbsp;&euro; \n\t y</p>", ["x &< é\xa0€ y"]),
        ("<div>a<script>var x='</p>';</script>b<style>p{}</style></div><!-- <p>no --> <ul><li>1<li>2</ul>", ["a b", "1", "2"]),
        ('<p title="a>b">c</p><p title=\'"\'>d</p><p "q>e', ["c", "d", "e"]),
        ("a < b <", ["a < b <"]),
        ("<script>never closed <p>x", []),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<p>one</p><svg><p>two</p>", ["one", "two"]),
        ("<p>a <math><mi>x</mi></math> b</p><canvas>fall back<p>c", ["a", "x", "b", "fall back", "c"]),
        ("<textarea>x</textarea><p>a<textarea>never closed<p>b", ["a", "never closed", "b"]),
        ("<p>a<!-- never closed <b>b</b></p><p>c", ["ab", "c"]),
        ("<p>a<!-- b --> <!doctype x> <?php y ?>c<a href='x>y'>d</a> e", ["a cd e"]),
        ("<p>a<b c='>' d='>f", ["a' d='>f"]),
        ("<p>x</div></span>y</p></p>z", ["x", "y", "z"]),
    ],
)
def test_leaf_blocks(page, want):
    assert [b.text for b in html.leaf_blocks(page)] == want


def test_hostile_pages_take_linear_time(field):
    import time

    units = ["<a ", "<div>a", "<!", "<!--", '<a "', "<a '>'", "<a<", "</x>", "<textarea>", "<script", "<p><b>", "<b class=abc>", '<div class="ad x%d">', "&#", "<li><ul>", "<td>"]
    for unit in units:
        page = "".join(unit % i if "%d" in unit else unit for i in range(1_000_000 // len(unit)))
        for one in (page, page + ">", "<div>" * 50_000 + page[:500_000]):
            at = time.process_time()
            html.decode(field, html.leaf_blocks(one, field.weights))
            assert time.process_time() - at < 15, unit


def layouts():
    """Pages unlike those of the training set's generator, with their main blocks."""
    body = ["The harbour was quiet that morning, and nobody spoke.", "Later, the ferry left; we watched it from the pier until it was gone.", "Nothing else happened for a week, or so they said."]
    links = "".join(f'<a href="/{w}">{w}</a> | ' for w in ("Home", "World", "Sport", "Mail"))
    yield f'<body><center>{links}</center><hr><h1>A quiet day</h1>{"".join(f"<p>{b}" for b in body)}<hr><p class=copyright>Copyright 1999 by us. All rights reserved.</body>', ["A quiet day", *body]
    yield f'<table class=layout><tr><td class="menu leftnav">{links}</td><td class=content><h2>A quiet day</h2>{"".join(f"<div>{b}</div>" for b in body)}</td></tr><tr><td class=footer>© 2003 Someone</td></tr></table>', ["A quiet day", *body]
    yield f'<div class="wp-site"><div class="site-header"><span class=logo>My site</span></div><nav class="main-navigation">{links}</nav><div class="entry"><h1 class="entry-title">A quiet day</h1><div class="entry-content">{"".join(f"<p>{b}</p>" for b in body)}<blockquote><p>So it goes, they said.</p></blockquote></div></div><div class="comments-area"><h2>2 comments</h2><p>First! I liked this, very much.</p></div><div class="widget-area sidebar"><h3>Recent</h3><ul><li><a href=x>Other</a></ul></div></div>', ["A quiet day", *body, "So it goes, they said."]
    yield f'<main role="main"><section><h1>A quiet day</h1><p>{body[0]}</p><figure><img src=x><figcaption>The pier at seven, seen from the hill.</figcaption></figure><p>{body[1]}</p><aside class="promo"><p>Subscribe now</p></aside><p>{body[2]}</p></section></main><footer><p>Imprint</p><p>Privacy</p></footer>', ["A quiet day", body[0], "The pier at seven, seen from the hill.", *body[1:]]
    yield f'<div id=cookie-banner>We use cookies. <button>OK</button></div><div id=page><div id=nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div><div id=main><h1>Ein stiller Tag</h1><p>Der Hafen war still, und niemand sprach ein Wort.</p><ol><li>Die Fähre fuhr ab, dann kam der Regen.</li><li>Wir sahen ihr lange nach.</li></ol></div></div><form action=s><label>Suche</label><input></form>', ["Ein stiller Tag", "Der Hafen war still, und niemand sprach ein Wort.", "Die Fähre fuhr ab, dann kam der Regen.", "Wir sahen ihr lange nach."]


def test_pages_in_other_layouts(field):
    right = total = 0
    for page, want in layouts():
        blocks = html.leaf_blocks(page)
        for b, keep in zip(blocks, html.decode(field, blocks), strict=True):
            right, total = right + (keep == (b.text in want)), total + 1
        assert [b for b in want if b not in [x.text for x in blocks]] == []
    assert right / total >= 0.9, right / total


def test_known_features_alone_give_the_same_labels(field):
    for page, _ in html.labelled_pages(60, seed=9):
        assert html.decode(field, html.leaf_blocks(page)) == html.decode(field, html.leaf_blocks(page, field.weights))


def test_extraction_edges_and_long_pages(spark, field):
    long = "<article><h1>T</h1>" + "<p>Some words here, and more of them. And so on.</p>" * 5000 + "</article>"
    rows = [(1, "u", "<nav><ul><li><a>x</a></li></ul></nav><article><h1>Head line</h1><p>Text of it, which is long enough.</p></article><footer>(c)</footer>", "c"), (None, None, None, None), (2, "v", "", "c"), (2, "v", "", "c"), (3, "w", long, "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html.extract(pages, field=field).collect()
    assert Counter((r["page_id"], r["url"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "Head line\nText of it, which is long enough." and by[None] == by[2] == "" and by[3].count("\n") == 5000
    assert html.extract(pages.where("false"), field=field).count() == 0


def test_extraction_of_the_tables_pages(spark, sf_dir):
    """The pages' articles, cut out by their tags."""
    import html as h

    want = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        blocks = re.split(r"</?(?:h1|p)\b[^>]*>", re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1])
        texts = [re.sub(r"[\x20\x09-\x0D]+", " ", h.unescape(re.sub(r"<[^>]*>", "", b))).strip(" ") for b in blocks]
        want[r["page_id"]] = "\n".join(t for t in texts if t)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op1_html(spark, sf_dir).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


# ---- WARC


def pages(spark):
    big, small = "<p>" + "é" * 600 + "</p>", "<p>tiny</p>"
    rows = [(1, "http://a/ b", big), (5, None, big), (3, "u", big), (2, "u", small), (4, "u", small), (6, "u", None), (7, "u", "x" * 3_000_000), (None, "u", big), (8, "u", "y" * 1000), (9, "u", "y" * 1000), (10, "u", "z" * 999), (11, "u", "z" * 999), (9, "u", "y" * 1000)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_archives_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    made = warc.write_archives(df.repartition(3), folder=f"file://{tmp_path}/w").collect()
    assert sum(r["n_records"] for r in made) == len(rows)
    got = warc.read_archives(spark, spark.createDataFrame([(r["path"],) for r in made], "path string")).collect()
    want = Counter()
    for i, _, text in rows:
        b = (text or "").encode()
        top = max((j for j, _, t in rows if t == text and j is not None), default=None)
        first = top if len(b) >= 1000 and sum(t == text for _, _, t in rows) > 1 and (i is None or i < top) else None
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if first else "response", first] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    payloads = {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert payloads[7] == b"x" * 3_000_000 and payloads[6] == b""
    for r in made:  # plain gzip reads the members in a row
        data = gzip.decompress(open(r["path"].removeprefix("file://"), "rb").read())
        assert data.count(b"WARC/1.1\r\n") == r["n_records"]


def test_empty_table_and_clashing_columns(spark, tmp_path):
    _, df = pages(spark)
    extra = df.withColumns({"digest": F.lit(1), "payload": F.lit(2), "first": F.lit(3)})
    made = warc.write_archives(extra, folder=f"file://{tmp_path}/x")
    assert made.agg(F.sum("n_records")).first()[0] == df.count()
    none = warc.write_archives(df.where("false"), folder=f"file://{tmp_path}/e").collect()
    assert sum(r["n_records"] for r in none) == 0


def test_damaged_archives_are_refused():
    record = warc.record_bytes("response", {"WARC-Block-Digest": warc.sha1_base32(b"body")}, b"body")
    good = list(warc.read_records(io.BytesIO(record + record)))
    assert [r.payload for r in good] == [b"body", b"body"] and list(warc.read_records(io.BytesIO(b""))) == []
    plain = gzip.decompress(record)
    for bad in (
        record[:-3], record + b"junk", gzip.compress(plain.replace(b"body\r", b"bodY\r")), gzip.compress(plain.replace(b"Content-Length: 4", b"Content-Length: 5")), gzip.compress(plain.replace(b"Content-Length: 4\r\n", b"")), gzip.compress(b"nothing\r\n\r\n"),
    ):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))


def standard(kind, block, content_type="application/http; msgtype=response", **headers):
    lines = [f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Type: {content_type}\r\nContent-Length: {len(block)}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items())]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_from_elsewhere(spark, tmp_path):
    body = b"<p>" + b"x" * 2000
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\n<p>\r\n7d0;a=b\r\n" + b"x" * 2000 + b"\r\n0\r\n\r\n"
    digest = warc.sha1_base32(body)
    data = standard("warcinfo", b"software: x\r\n", "application/warc-fields") + standard("request", b"GET / HTTP/1.1\r\n\r\n")
    data += standard("response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body, WARC_Target_URI="http://a/", WARC_Payload_Digest=digest)
    data += standard("response", chunked, WARC_Target_URI="http://b/", WARC_Payload_Digest=digest) + standard("resource", b"plain", "text/plain", WARC_Payload_Digest="md5:" + hashlib.md5(b"plain").hexdigest())
    data += standard("revisit", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Target_URI="http://c/", WARC_Payload_Digest=digest) + standard("revisit", b"", WARC_Payload_Digest=warc.sha1_base32(b"unknown"))
    (tmp_path / "a.warc.gz").write_bytes(data)
    records = warc.read_archives(spark, spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string"))
    got = Counter((r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in warc.resolved(records).collect())
    sha = lambda b: hashlib.sha1(b).hexdigest()
    assert got == Counter([("http://a/", 2003, sha(body), "response"), ("http://b/", 2003, sha(body), "response"), (None, 5, sha(b"plain"), "response"), ("http://c/", 2003, sha(body), "revisit"), (None, None, sha(b"unknown"), "revisit")])
    for bad in (standard("response", b"no end"), standard("response", b"HTTP/1.1 200 OK\r\n\r\nx", WARC_Payload_Digest=digest), standard("resource", b"x", "a/b", X_Page_ID="y"), standard("resource", b"x", "a/b", WARC_Payload_Digest="sha1:1")):
        with pytest.raises(warc.WarcError):
            list(map(warc.page_of, warc.read_records(io.BytesIO(bad))))


def test_one_page_as_a_third_of_all(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "HOT", 10)
    rows = [(i, "u", "e" * 1500 if i % 3 == 0 else f"{i // 2} " * 500) for i in range(300)]
    made = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), folder=f"file://{tmp_path}/h")
    got = {r["page_id"]: r["refers_to"] for r in warc.read_archives(spark, made).collect()}
    last = {t: i for i, _, t in rows}
    assert got == {i: last[t] if last[t] != i else None for i, _, t in rows}


# ---- language model


def corpus():
    rng = random.Random(1)
    subject, verb, thing = ["cat", "dog", "bird", "fox"], ["sees", "hears", "finds"], ["food", "water", "home", "snow"]
    sentence = lambda: f"the {rng.choice(subject)} {rng.choice(verb)} the {rng.choice(thing)} ."
    return [(i, " ".join(sentence() for _ in range(rng.randrange(3, 20)))) for i in range(600)]


@pytest.fixture(scope="module")
def model(spark):
    return lm.train(spark.createDataFrame(corpus(), "doc_id bigint, text string"))


def chances(model, words, at):
    """Probability of every id at one place of a text."""
    row, places = lm._framed(lm._ids(model, words, len(words)), np.array([len(words)]))
    out = []
    for i in range(lm.UNKNOWN, len(model.counts)):
        row[places[at]] = i
        out.append(math.exp(lm.log_words(model, row, places[at : at + 1])[0]))
    return np.array(out)


def test_conditionals_sum_to_one(spark, model):
    words = b"the cat sees the food . zebra the".split()
    assert all(chances(model, words, at).sum() == pytest.approx(1, abs=1e-4) for at in range(len(words)))
    assert np.exp(model.letters).sum() == pytest.approx(1)
    rng = np.random.default_rng(1)
    many = lm.vocabulary(spark.createDataFrame([(f"w{i}".encode(), int(n)) for i, n in enumerate(rng.zipf(1.3, 1500).clip(1, 10**6))], "word binary, n bigint"))
    assert len(many.first) > 8 and max(many.sizes) > 64
    assert chances(many, [b"w1", b"w2"], 0) == pytest.approx(many.counts[1:] / many.counts.sum(), rel=1e-3)  # before training: shares
    for w in many.weights[:2]:
        w += rng.normal(size=w.shape).astype(np.float32)
    assert chances(many, [b"w1", b"w2"], 0).sum() == pytest.approx(1, abs=1e-4)


def test_scores_equal_a_plain_version(spark, model):
    texts = [None, "", " ", "the cat", "The CAT sees the snow .", "zq-unknown the dog zq2", "a " * 5000]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()}
    embed, nodes, biases, place, bias, out, out_bias = (w.astype(float) for w in model.weights)
    known = dict(zip(model.keys.tolist(), model.ids.tolist(), strict=True))
    for i, text in enumerate(texts):
        w = (text or "").lower().encode().split()
        ids = [0, 0, *(known.get(int(lm._hashed([x])[0]), lm.UNKNOWN) for x in w), 0, 0]
        total = 0.0
        for t in range(2, len(ids) - 2) if len(w) < 100 else []:
            h = np.tanh(bias + sum(embed[ids[t + d]] @ place[k] for k, d in enumerate((-2, -1, 1, 2))))
            s, c = h @ out + out_bias, model.of_class[ids[t]]
            total += s[c] - np.log(np.exp(s).sum())
            child = ids[t] - model.first[c] + model.sizes[c]
            while child > 1:
                odds = h @ nodes[model.first[c] + child // 2] + biases[model.first[c] + child // 2]
                total -= np.log1p(np.exp(-odds if child % 2 else odds))
                child //= 2
            if ids[t] == lm.UNKNOWN:
                total += sum(model.letters[b] for b in w[t - 2]) + model.letters[256]
        assert got[i]["n_tokens"] == len(w) and (got[i]["mean_log_likelihood"] is None) == (not w)
        if len(w) < 100:
            assert got[i]["log_likelihood"] == pytest.approx(total, abs=1e-3)


def test_context_beats_word_frequencies_and_order_matters(model):
    rng = random.Random(2)
    held = [f"the {rng.choice(['cat', 'dog', 'fox'])} {rng.choice(['sees', 'finds'])} the {rng.choice(['food', 'home'])} ." for _ in range(50)]
    shuffled = [" ".join(rng.sample(t.split(), 6)) for t in held]
    n, a = lm.log_likelihoods(model, [t.encode() for t in held])
    _, b = lm.log_likelihoods(model, [t.encode() for t in shuffled])
    counts = Counter(w for _, t in corpus() for w in t.split())
    frequency = sum(math.log(counts[w] / sum(counts.values())) for t in held for w in t.split()) / n.sum()
    assert a.sum() / n.sum() > frequency + 0.5 and a.mean() > b.mean() + 2


def test_steps_follow_the_gradient(model):
    """The change of one small step against differences of the score."""
    row, places = lm._framed(lm._ids(model, b"the cat sees the food . the dog hears".split(), 9), np.array([9]))
    old = model._replace(weights=[w.astype(float) for w in model.weights])
    new = model._replace(weights=[w.copy() for w in old.weights])
    lm.sgd(new, row, places, 1e-3, np.full(len(model.counts), 1e-3))
    rates = [1e-3, 1e-3 / (1 + 9 / len(model.first)) ** 0.5, 1e-3 / (1 + 9 / len(model.first)) ** 0.5, *[1e-3 / 12] * 4]
    rng = np.random.default_rng(2)
    for k, (w, moved, rate) in enumerate(zip(old.weights, new.weights, rates, strict=True)):
        changed = np.argwhere(np.abs(moved - w) > 1e-7)
        for at in changed[rng.permutation(len(changed))[:6]]:
            both = []
            for step in (1e-4, -1e-4):
                bent = [x.copy() for x in old.weights]
                bent[k][tuple(at)] += step
                both.append(lm.log_words(old._replace(weights=bent), row, places).sum())
            assert (moved - w)[tuple(at)] / rate == pytest.approx((both[0] - both[1]) / 2e-4, rel=0.02, abs=1e-3), (k, at)


def test_the_vocabulary_follows_the_corpus(spark):
    common, rare = [f"w{i}" for i in range(9000)], ["zzz", "q"]
    counts = spark.createDataFrame([(w.encode(), 7) for w in common] + [(rare[0].encode(), 2), (rare[1].encode(), 1)], "word binary, n bigint")
    m = lm.vocabulary(counts)
    assert set(m.keys.tolist()) == {int(lm._hashed([w.encode()])[0]) for w in common} and len(m.weights[1]) == 9002 and m.counts[lm.UNKNOWN] == 3
    seen = Counter("".join(w * 7 for w in common) + "zzzzzz" + "q")
    total = sum(seen.values()) + 63003 + 257
    assert all(np.exp(m.letters[ord(c)]) == pytest.approx((n + 1) / total) for c, n in seen.items())


def test_every_word_is_masked_once_over_the_rounds():
    n = np.array([0, 1, 7, 0, 1000])
    for rounds in (1, 2, 3, lm.ROUNDS):
        masked = [lm.targets(n, r, rounds) for r in range(rounds)]
        assert (np.sum(masked, axis=0) == 1).all() and len(masked[0]) == 1008
        assert [m.sum() for m in masked] == [np.ceil((n - r) / rounds).clip(0).sum() for r in range(rounds)]


def test_choices_lead_down_to_every_word(model):
    """Each class's words are the leaves of a tree whose inner nodes are all chosen at, from the last on."""
    goal = np.arange(lm.UNKNOWN, len(model.counts))
    classes = model.of_class[goal].astype(int)
    which, node, right = lm._choices(model, goal, classes)
    for i, (word, c) in enumerate(zip(goal, classes, strict=True)):
        leaf, size = 1, int(model.sizes[c])
        for at, turn in zip(node[which == i][::-1], right[which == i][::-1], strict=True):
            assert at == model.first[c] + leaf and leaf < size
            leaf = 2 * leaf + turn
        assert leaf - size == word - model.first[c]
    assert set(node) == {f + k for f, n in zip(model.first, model.sizes, strict=True) for k in range(1, n)}


def test_production_training_on_documents(spark, sf_dir):
    """On documents not trained on: better than word shares, and than the classes alone; reruns agree."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    taught, held = docs.where("doc_id % 10 <> 0"), [r["text"].encode() for r in docs.where("doc_id % 10 = 0 and text is not null").collect()]
    m = lm.train(taught)
    counts = Counter()
    for r in taught.select("text").collect():
        counts.update(lm._words((r["text"] or "").encode()))
    before = lm.vocabulary(spark.createDataFrame(list(counts.items()), "word binary, n bigint"))
    assert (before.keys == m.keys).all() and (before.counts == m.counts).all()
    flat = m._replace(weights=[m.weights[0], np.zeros_like(m.weights[1]), before.weights[2], *m.weights[3:]])
    n = lm.log_likelihoods(m, held)[0].sum()
    shares, classes, words = (lm.log_likelihoods(x, held)[1].sum() / n for x in (before, flat, m))
    assert words > classes + 0.05 and classes > shares + 0.05
    assert all((a == b).all() for a, b in zip(m.weights, lm.train(taught).weights, strict=True))


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    m = lm.train(none)
    assert lm.score(none, m).count() == 0 and lm.train_and_score(none).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, "a b")], "doc_id bigint, text string")
    assert lm.score(nulls, lm.train(nulls)).count() == 2
    clash = nulls.withColumns({"ids": F.lit(1), "spelled": F.lit("x"), "_none": F.lit(2)})
    assert {(r["doc_id"], r["n_tokens"], r["log_likelihood"] == 0) for r in lm.train_and_score(clash).collect()} == {(1, 0, True), (None, 2, False)}


# ---- embeddings


def brute_links(rows):
    unit = []
    for _, v, label in rows:
        a = np.array([np.nan if x is None else x for x in v], float) if v else np.array([np.nan])
        unit.append(a / np.linalg.norm(a) if label is not None and np.isfinite(a).all() and a.any() else None)
    n = len(rows)
    above, links = list(range(n)), [0] * n

    def root(x):
        return x if above[x] == x else root(above[x])

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                above[b] = a
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(rows[i][0])
    return {rows[i][0]: (links[i], min(groups[root(i)])) for i in range(n)}


def make_vectors(seed, n=300, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        kind = i % 6
        v = rng.normal(size=dim) if kind < 3 or i < 10 else np.array(rows[int(rng.integers(i - 5)) if kind < 5 else 3][1] or rng.normal(size=dim)) + rng.normal(size=dim) * (0.1 if kind == 3 else 0.0 if kind == 4 else 0.02)
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(2)) if kind < 3 else rows[3][2] if i > 3 else 0))
    return rows


@pytest.mark.parametrize(("seed", "per_cell", "block"), [(1, 2000, 2048), (2, 4, 2048), (3, 2, 16)])
def test_links_equal_brute_force(spark, monkeypatch, seed, per_cell, block):
    monkeypatch.setattr(vectors, "PER_CELL", per_cell)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = make_vectors(seed)
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_links(rows) and len(got) == len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_odd_vectors(spark):
    e = [1.0] + [0.0] * 7
    rows = [(1, e, 1), (2, e, 1), (3, [2.0] + [0.0] * 7, 1), (4, e, None), (5, None, 1), (6, [0.0] * 8, 1), (7, [None, *e[1:]], 1), (8, [float("nan"), *e[1:]], 1), (9, [float("inf"), *e[1:]], 1), (10, [1.0, 0.0], 1), (11, [1.0], 1), (12, [3.0], 1), (13, [], 1), (14, e, 2), (15, [1e30] + [0.0] * 7, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, node string, cell int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    assert len(got) == len(rows)
    for i in (1, 2, 3, 15):
        assert got[i] == (3, 1, i == 1)
    for i in (4, 5, 6, 7, 8, 9, 10, 13, 14):
        assert got[i] == (0, i, True)
    assert got[11] == (1, 11, True) and got[12] == (1, 11, False)
    with_null = df.unionByName(df.where("vec_id = 1").withColumn("vec_id", F.lit(None).cast("bigint")))
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(with_null).where("vec_id is null").collect()] == [(0, None, True)]
    assert vectors.near_vectors(df.where("false")).count() == 0
    repeated = df.where("vec_id <= 2").unionByName(df.where("vec_id = 1"))
    assert {r["n_links"] for r in vectors.near_vectors(repeated).collect()} == {2}


def test_multi_sequence_is_sorted_and_whole():
    rng = np.random.default_rng(3)
    a, b = rng.random(6), rng.random(5)
    cells = list(vectors.multi_sequence(a, b, 1.2))
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and len(cells) == len(set(cells)) == int(((a[:, None] + b) <= 1.2).sum())


def test_bounds_never_exceed_the_true_shift():
    rng = np.random.default_rng(4)
    words = rng.normal(size=(7, 5))
    x = rng.normal(size=(200, 5))
    y = x + rng.normal(size=(200, 5)) * 0.5
    own_y = vectors.squared(y, words).argmin(axis=1)
    _, need = vectors.bounds(x, words)
    assert (need[np.arange(200), own_y] <= ((x - y) ** 2).sum(axis=1) + 1e-9).all()


def test_keys_are_found_by_their_leading_bits():
    rng = np.random.default_rng(4)
    for n in (1, 2, 1000):
        crowd = rng.integers(0, 50, n, dtype=np.uint64)  # all in the first bucket
        for keys in (rng.integers(0, 2**64, n, dtype=np.uint64, endpoint=False), crowd, np.append(crowd, np.uint64(2**64 - 1))):
            keys = np.unique(keys)
            wanted = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
            at = lm._found(keys, lm._starts(keys), wanted)
            assert (np.isin(wanted, keys) == (keys[at] == wanted)).all()


def test_choices_of_one_step_are_of_the_first_words(spark):
    """In the order by depth, each step's choices are of a stretch of the first words, so no row of the hidden layer is copied."""
    rng = np.random.default_rng(5)
    model = lm.vocabulary(spark.createDataFrame([(f"w{i}".encode(), int(n)) for i, n in enumerate(rng.zipf(1.3, 1500).clip(1, 10**6))], "word binary, n bigint"))
    for w in model.weights[:2]:
        w += rng.normal(size=w.shape).astype(np.float32)
    goal = rng.integers(lm.UNKNOWN, len(model.counts), 200)
    goal = goal[lm._by_depth(lm._leaves(model, goal, model.of_class[goal])[1])]
    which, node, right = lm._choices(model, goal, model.of_class[goal])
    steps = lm._steps(which)
    assert len(steps) > 1 and all((which[own] == np.arange(200)[rows]).all() for own, rows in steps)
    assert sum(own.stop - own.start for own, _ in steps) == len(which) == len(node) == len(right)
    assert lm._steps(which[:0]) == [] and len(lm._choices(model, goal[:0], goal[:0])[0]) == 0
    row, places = lm._framed(goal.astype(np.int32), np.array([200]))
    together = lm.log_words(model, row, places)
    assert together == pytest.approx([lm.log_words(model, row, places[k : k + 1])[0] for k in range(200)], abs=1e-4)


def test_words_are_cut_and_hashed_together():
    """All texts at once give the words of each text, and a word has one hash wherever it begins."""
    rng = random.Random(6)
    texts = [None, b"", b" ", b"a", "\u00c9 ZE\u0301\u2003x".encode(), b"A\x0bB\x0c c\x1cd\x85e\t\r\n", bytes(range(256)), b"x" * 5000, b"\0 \0\0 " + bytes(8) + b" " + bytes(9)]
    texts += [b" ".join(bytes(rng.choices(b"abC", k=rng.randrange(1, 30))) for _ in range(rng.randrange(40))) for _ in range(50)]
    for lo in range(0, len(texts), 7):
        some = texts[lo : lo + 7]
        row, begins, lengths, n = lm._cut(some)
        words = [w for text in some for w in lm._words(text)]
        assert [bytes(row[i : i + k]) for i, k in zip(begins, lengths, strict=True)] == words
        assert n.tolist() == [len(lm._words(text)) for text in some]
        assert (lm._hashes(row, begins, lengths) == lm._hashed(words)).all()
    words = {w for text in texts for w in lm._words(text)} | {bytes(97 + (i >> k & 1) for k in range(17)) for i in range(1 << 12)}
    assert len(set(lm._hashed(list(words)).tolist())) == len(words) > 4096
    assert all(len(x) == 0 for x in (*lm._cut([])[1:], lm._hashed([])))


def test_words_are_counted_by_hash(spark):
    """Only hashes leave the tasks; vocabulary, counts and letters are those of the table of words."""
    texts = [None, "", "a b b", "B \u00e9t\u00e9 \u00c9", *("the cat sees %d" % (k % 9) for k in range(80)), "x" * 3000]
    docs = spark.createDataFrame([(t,) for t in texts], "words string").repartition(3)
    one, two = lm.corpus_vocabulary(docs, "words"), lm.vocabulary(lm.word_counts(docs, "words"))
    assert len(one.keys) > 4 and one.counts[lm.UNKNOWN] == two.counts[lm.UNKNOWN] > 1
    for a, b in zip(one, two, strict=True):
        assert all((x == y).all() for x, y in zip(a, b, strict=True)) if isinstance(a, list) else (a == b).all()


def test_ids_are_stored_in_parts(spark):
    """Of 70,000 words: every id is read back, and no row has a value per word."""
    words = [f"w{i}" for i in range(70_000)]
    model = lm._untrained(np.sort(lm._hashed([w.encode() for w in words])), np.arange(70_000) + 5, 3, np.ones(257))
    texts = [None, "W1 unknown", *(" ".join(words[k : k + 999]) for k in range(0, 70_000, 999)), ""]
    table = lm.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), model)
    assert not any("array" in kind for _, kind in table.dtypes)
    found = table.toArrow().combine_chunks().to_batches()[0]
    ids, n = (np.concatenate(x) for x in list(zip(*lm._lists(found, 10), strict=True))[1:])
    assert n.tolist() == [len((t or "").split()) for t in texts] and ids.max() == 70_001
    assert (ids == lm._ids(model, [w.encode() for t in texts for w in (t or "").lower().split()], len(ids))).all() and (ids == lm.UNKNOWN).sum() == 1


def test_rows_are_added_as_often_as_they_come():
    rng = np.random.default_rng(7)
    for kind in (np.float32, np.float64):
        rows, at, changes = rng.normal(size=(5, 16)).astype(kind), rng.integers(0, 5, 200), rng.normal(size=(200, 16)).astype(kind)
        wanted = rows.copy()
        for k, change in zip(at, changes, strict=True):
            wanted[k] += change
        lm._added(rows, at, changes)
        assert (rows == wanted).all()
    assert (lm._wide(np.arange(3.0), 2) == [[0, 0], [1, 1], [2, 2]]).all()


def test_batches_planned_together_are_the_single_ones(spark):
    rng = np.random.default_rng(8)
    model = lm.vocabulary(spark.createDataFrame([(f"w{i}".encode(), int(n)) for i, n in enumerate(rng.zipf(1.3, 1500).clip(1, 10**6))], "word binary, n bigint"))
    row, places = lm._framed(rng.integers(lm.UNKNOWN, len(model.counts), lm.PLANNED * lm.BATCH + 1500).astype(np.int32), np.array([lm.PLANNED * lm.BATCH + 1500]))
    got = list(lm._batches(model, row, places))
    assert [len(b[0]) for b in got] == [lm.BATCH] * (lm.PLANNED + 1) + [1500 - lm.BATCH]
    for k in (0, 1, lm.PLANNED - 1, lm.PLANNED, lm.PLANNED + 1):
        classes, seen, node, right, steps = got[k]
        at = places[k * lm.BATCH : (k + 1) * lm.BATCH]
        at = at[lm._by_depth(lm._leaves(model, row[at], model.of_class[row[at]])[1])]
        assert (classes == model.of_class[row[at]]).all() and (seen == row[at[:, None] + lm._AROUND]).all()
        which, nodes, turns = lm._choices(model, row[at].astype(np.int64), classes)
        assert (node == nodes).all() and (right == turns).all() and steps == lm._steps(which)
    assert list(lm._batches(model, row, places[:0])) == []
    alone = list(lm._batches(model, np.full(5, lm.UNKNOWN, np.int32), np.array([2])))  # a class of one word has no choices
    assert len(alone) == 1 and len(alone[0][2]) == 0 and alone[0][4] == []
