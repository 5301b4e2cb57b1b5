"""Near-dedup, classifiers, extraction, language model and chroma prints against plain Python or held-out rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tessera.llm import chroma as K
from tessera.llm import html as H
from tessera.llm import lm, quality, toxicity
from tessera.llm import near_dedup as N
from tessera.llm.components import components
from tessera.llm.labelled import auc, fold
from tessera.llm.shingles import shingle_sets

DOCS = "doc_id long, text string"


def brute(texts, width, threshold):
    def sh(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    s, up = [sh(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and 100 * len(s[i] & s[j]) >= round(100 * threshold) * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [(len(x), find(i)) for i, x in enumerate(s)]


@pytest.mark.parametrize("width,threshold", [(3, 0.85), (5, 0.8)])
def test_near_duplicates(spark, width, threshold, monkeypatch):
    monkeypatch.setattr(N, "LEFT", 4)  # small blocks, so that a group spans several
    monkeypatch.setattr(N, "RIGHT", 8)
    r = random.Random(width)
    base = [r.choice("abcdefgh") + str(r.randint(0, 99)) for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(60):  # a chain of copies of copies
        w = texts[r.randrange(len(texts))].split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = str(r.random())
        texts.append(" ".join(w))
    texts += texts[:5] + [None, "", " \n", "a b", "A  B", "a", "one two three four five six"] * 2 + [" ".join(str(r.randint(0, 9**9)) for _ in range(20_000))] * 2
    got = N.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS), width=width, threshold=threshold).collect()
    want = brute(texts, width, threshold)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == dict(enumerate(want))
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_near_duplicates_edges(spark):
    assert N.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 1), (None, "a b c d e f", 2), (3, "a b c d e f", 3)], DOCS + ", kept int")
    got = N.near_duplicates(rows).collect()
    assert sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (3, 1, False)]
    assert {(x.doc_id, x.kept) for x in N.drop_near_duplicates(rows).collect()} == {(1, 1), (None, 2)}


def test_sketches_bound_what_is_linked():
    r = np.random.default_rng(0)
    bands, k = N.banding(0.85)
    by = np.random.default_rng(5).integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bound, over = N.sketch_bound(0.85, k), 0
    for _ in range(200):
        u = np.unique(r.integers(0, 2**63, 400, dtype=np.uint64))
        v = np.unique(np.r_[u[: int(len(u) * 0.92)], r.integers(0, 2**63, int(len(u) * 0.08), dtype=np.uint64)])
        a, b = N.odd_sketch(N._samples(u, by)), N.odd_sketch(N._samples(v, by))
        over += int(np.bitwise_count(a ^ b).sum()) > bound
    assert over == 0 and (1 - 0.85**N.ROWS) ** bands < 1e-6


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(500, 600 + i) for i in range(40)] + [(i, i + 1) for i in range(700, 740)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {x.id: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for p in pairs for n in p if p[0] != p[1]}


def test_shingles_know_white_space_and_case():
    a, b, c = shingle_sets(["A b\tc d", "a\x0bB  c\nd", "é x b c d"], 3)
    assert list(a) == list(b) and len(a) == 2 and len(c) == 2
    assert [len(x) for x in shingle_sets([None, "", "one", "one two", "ONE two"], 3)] == [0, 0, 1, 1, 1]


def labelled(spark, sf, column):
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return d, y, d.select("doc_id", "text").join(y, "doc_id").toPandas()


def test_quality(spark, sf):
    d, y, m = labelled(spark, sf, "quality")
    got = quality.score_quality(d.select("doc_id", "text"), y, text=False).toPandas().merge(m[["doc_id", "quality"]], on="doc_id")
    assert auc(got.quality.values, got.score.values) > 0.97
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    model = quality.quality_model(quality.measured(d.select("doc_id", "text"), "x"), y, "x")
    assert 0.5 < model.prior <= 0.98
    rows = [(10**9 + 1, None, 7.0), (10**9 + 2, "", 7.0), (10**9 + 3, "x" * 300_000, 7.0), (None, " \n", 7.0), (None, " \n", 7.0)]
    edge = spark.createDataFrame(rows, DOCS + ", Score double").withColumn("a.b", F.lit(1))
    both = quality.score_quality(d.select("doc_id", "text", F.lit(0.0).alias("Score"), F.lit(2).alias("a.b")).union(edge), y)
    assert both.columns == ["doc_id", "text", "a.b", "held_out", "score", "predicted"]
    last = both.filter("doc_id > 1000000000 OR doc_id IS NULL").collect()
    assert len(last) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in last)
    assert len({r.score for r in last if r.doc_id is None}) == 1
    assert {r.score for r in quality.score_quality(edge, y.limit(0)).collect()} == {1.0}
    assert quality.score_quality(edge.limit(0), y).count() == 0


def test_quality_scores_are_those_of_a_plain_loop(spark, sf, monkeypatch):
    d, y, m = labelled(spark, sf, "quality")
    kept = {}
    monkeypatch.setattr(quality, "quality_model", lambda *a, f=quality.quality_model, **k: kept.setdefault("m", f(*a, **k)))
    got = {r.doc_id: r.score for r in quality.score_quality(d.select("doc_id", "text"), y).collect()}
    model = kept["m"]
    every = np.array([quality.features(t) for t in d.toPandas().text])
    assert model.means == pytest.approx(every.mean(axis=0)) and model.scales == pytest.approx(every.std(axis=0) + 1e-6, rel=1e-6)
    for i, t in list(zip(m.doc_id, m.text, strict=True))[:40]:
        z = model.bias
        x = [max(-6.0, min(6.0, (v - a) / s)) for v, a, s in zip(quality.features(t), model.means, model.scales, strict=True)]
        for j in range(len(model.out)):
            z += model.out[j] * max(0.0, sum(x[k] * model.hidden[k, j] for k in range(len(x))) + model.hidden_bias[j])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(z * model.slope + model.shift))), rel=1e-6, abs=1e-9)


def test_positive_unlabelled_risk_learns_without_negatives():
    r = np.random.default_rng(0)
    pos, neg = r.normal(1.5, 1, (4000, 4)), r.normal(-1.5, 1, (1200, 4))
    mixed = np.vstack([r.normal(1.5, 1, (3000, 4)), neg[:1000]])
    edges = np.unique(np.quantile(pos.sum(axis=1), np.linspace(0, 1, 65)))
    counts = np.bincount(np.searchsorted(edges, mixed.sum(axis=1), side="right"), minlength=len(edges) + 1)
    prior = quality.estimate_prior(pos.sum(axis=1), edges, counts)
    assert abs(prior - 0.75) < 0.12
    p = quality.fit_pu(pos, mixed, prior, epochs=10)
    z = quality._forward(np.vstack([pos[:300], neg[1000:]]), *p[:3], p[3][0])[1]
    assert auc(np.r_[np.ones(300), np.zeros(200)], z) > 0.97


def test_toxicity(spark):
    r = random.Random(3)
    plain, bad = [f"w{i}" for i in range(200)], ["vile", "scum", "trash", "moron"]
    rows = []
    for i in range(600):
        w = [r.choice(plain) for _ in range(r.randint(10, 80))]
        y = int(i % 8 == 0)
        for _ in range(4 * y):
            w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", ",", "!!"]))
        rows.append((i, " ".join(w), y))
    d = spark.createDataFrame(rows, DOCS + ", toxic int")
    got = toxicity.score_toxicity(d.drop("toxic"), d.select("doc_id", "toxic")).join(d, "doc_id").toPandas()
    h = got[got.held_out]
    assert auc(h.toxic.values, h.score.values) > 0.98 and (h.predicted == h.toxic).mean() > 0.95
    edge = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "scum " * 50_000)], DOCS)
    clash = edge.union(d.select("doc_id", "text")).withColumn("x", F.lit(1)).withColumn("V", F.lit(1)).withColumn("score", F.lit("s"))
    scored = toxicity.score_toxicity(clash, d.select("doc_id", "toxic")).collect()
    assert len(scored) == 604 and all(0 <= x.score <= 1 for x in scored) and [x.predicted for x in scored if x.doc_id is None] == [1]
    assert toxicity.score_toxicity(edge.limit(0), d.select("doc_id", "toxic")).count() == 0
    assert {x.score for x in toxicity.score_toxicity(edge, d.select("doc_id", "toxic").limit(0)).collect()} == {0.0}


def test_label_model_lowers_correlated_voters_and_beats_the_majority():
    r = np.random.default_rng(1)
    y = r.random(20_000) < 0.3
    weak = np.where(r.random(20_000) < 0.6, y, ~y) * 2 - 1
    strong = [np.where(r.random(20_000) < p, y, ~y) * 2 - 1 for p in (0.9, 0.85, 0.85)]
    votes = np.stack([weak, weak, weak, weak, *strong], axis=1)
    keys, inv = np.unique(votes, axis=0, return_inverse=True)
    post, got = toxicity.label_model(keys.astype(float), np.bincount(inv, minlength=len(keys)).astype(float), 0.3)
    assert max(got["damping"][:4]) < 0.5 < min(got["damping"][4:]) and got["correlations"][0, 1] > 0.9
    assert ((post[inv] >= 0.5) == y).mean() > ((votes.sum(axis=1) > 0) == y).mean() + 0.05
    right = got["accuracies"][1, :, 2]  # a vote of 1 given label 1, learned without a label
    assert abs(right[4] - 0.9) < 0.1 and right[0] < right[5]


def test_toxicity_through_posteriors(spark, monkeypatch):
    """The given labels of rows are no targets: the classifier learns what the label model says, from all documents."""
    r = random.Random(3)
    plain, bad = [f"w{i}" for i in range(300)], ["vile", "scum", "trash", "moron"]
    rows = []
    for i in range(900):
        w = [r.choice(plain) for _ in range(r.randint(10, 80))]
        y = int(i % 8 == 0)
        for _ in range(r.randint(2, 5) * y):
            w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", "s", "ish"]))
        rows.append((i, " ".join(w), y))
    d = spark.createDataFrame(rows, DOCS + ", toxic int")
    labels = d.filter("doc_id < 700").select("doc_id", "toxic")
    model, measured, balance = toxicity.fit(d.drop("toxic"), labels)
    assert {t.rstrip("*") for t in model.lexicon.odds} >= {"vile", "scum"} and abs(balance - 0.125) < 0.03
    cells = toxicity.corpus_cells(measured)
    assert sum(n for _, n, _ in cells) == 900
    # Measures, votes, cells and scores of a plain loop.
    by = {}
    for _, t, _ in rows:
        m = toxicity.measures(t, model.lexicon)
        by.setdefault((tuple(toxicity.votes(m)), math.floor(m[toxicity.LEXICONS + 7])), []).append(m)
    assert sorted(len(x) for x in by.values()) == sorted(int(n) for _, n, _ in cells)
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(d.drop("toxic"), labels).collect()}
    for i, t, _ in rows[:50]:
        z = model.bias + sum(w * max(-toxicity.FAR, min(toxicity.FAR, (x - a) / s)) for w, x, a, s in zip(model.weights, toxicity.measures(t, model.lexicon), model.means, model.scales, strict=True))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, z)))), abs=1e-6)
    # With posteriors turned round, the scores turn round: nothing else is a target.
    turned = toxicity.train(cells, balance, model.lexicon, posterior=lambda *a: (1 - toxicity.label_model(*a)[0], {}))
    x = np.array([toxicity.measures(t, model.lexicon) for _, t, _ in rows])
    y = np.array([v for _, _, v in rows])
    assert auc(y, toxicity.score_measures(x, model)) > 0.97 and auc(y, toxicity.score_measures(x, turned)) < 0.2


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"),
        ("<nav><a href=x>Home</a></nav><article><header><h1>T</h1></header><p>One, two &eacute;.<p>Th<b>re</b>e<br>four</article><footer>f</footer>", "T One, two é. Three four"),
        ('<div class="sidebar">s</div><main><p>Body, text.</p><form><p>mail</p></form><div id="comments"><p>nice, very nice</p></div></main>', "Body, text."),
        ("<body><script>var a='<p>x</p>'</script><!-- <p>c</p> --><div><h2>H</h2><p>Long enough, really, it is.</p></div><aside>zz</aside>", "H Long enough, really, it is."),
        ('<div class="cookie-notice">We use cookies</div><div class="post"><p>a, b, c</p><ul><li>i<li>j</ul></div><div class="ad">buy</div>', "a, b, c i j"),
        ("<table><tr><td>a<td>b</table>", "a b"), ("<p>1 < 2 and <b>x", "1 < 2 and x"),
    ],
)
def test_main_text(page, want):
    assert H.main_text(page) == want


@pytest.mark.parametrize(
    "page",
    ['<div class="legal-article"><p>{}</p></div>', '<div id="share-price-story"><p>{}</p></div>', '<div class="widget-content"><p>{}</p></div>', '<article class="related"><p>{}</p></article>', '<div class="promo"><p>{}</p></div><div class="content"><p>Short.</p></div>'],
)
def test_names_alone_drop_no_article(page):
    text = " ".join(["Shares fell again, as they did before, on the news."] * 12)
    assert H.main_text(page.format(text)) == text


def made_pages(n=60):
    """Pages without article or main elements, with misleading names: (html, text of the article)."""
    r, out = random.Random(9), []
    line = lambda k: " ".join(r.choice("alpha beta gamma delta epsilon zeta".split()) + r.choice(["", "", "", ","]) for _ in range(k)) + "."
    for _ in range(n):
        body = [line(r.randint(25, 60)) for _ in range(r.randint(3, 6))]
        name = r.choice(['class="promo"', 'class="widget"', 'id="related"', "", 'class="x1"', 'class="legal notice"'])
        side = "".join(f"<p>{line(4)}</p>" for _ in range(2))
        links = "".join(f'<li><a href="/{i}">{line(3)}</a></li>' for i in range(8))
        article = f"<div {name}>" + "".join(f"<p>{p}</p>" for p in body) + "</div>"
        rest = [f'<div class="content"><ul>{links}</ul></div>', f'<div class="sidebar">{side}</div>', f'<div class="comments"><p>{line(6)}</p></div>']
        blocks = [article, *rest]
        r.shuffle(blocks)
        out.append((f"<html><body>{''.join(blocks)}</body></html>", " ".join(body)))
    return out


def test_scores_decide(monkeypatch):
    pages = made_pages()
    assert [H.main_text(p) for p, _ in pages] == [t for _, t in pages]
    r, score = random.Random(2), H._score

    def at_random(nodes):
        score(nodes)
        for x in nodes:
            x.points = r.random() * 100

    monkeypatch.setattr(H, "_score", at_random)
    assert sum(H.main_text(p) != t for p, t in pages) > 40


def slow_points(x):
    """Points of a node, summed anew from each paragraph below it or in it."""

    def chars(k):
        return 0 if k.gone else sum(len(c.strip()) if isinstance(c, str) else chars(c) for c in k.kids)

    def linked(k):
        return 0 if k.gone else chars(k) if k.tag == "a" else sum(linked(c) for c in k.kids if not isinstance(c, str))

    def phrases(k):
        return "".join(c if isinstance(c, str) else "" if c.gone or c.tag in H.BLOCK else phrases(c) for c in k.kids)

    def density(k):
        return linked(k) / max(1.0, chars(k))

    def below(k):
        yield k
        for c in k.kids:
            if not isinstance(c, str) and not c.gone:
                yield from below(c)

    total = 0.0
    for k in below(x):
        text = phrases(k).strip()
        own = any(isinstance(c, str) and c.strip() for c in k.kids)
        if not text or not (k.tag in H.PARAGRAPHS or k.tag in H.CONTAINERS and own):
            continue
        way, up = [], k
        while up is not x:
            way.append(up)
            up = up.up
        if k.tag in H.PARAGRAPHS and k is x:
            continue  # its points go to what it is in
        level = len(way) if k.tag in H.CONTAINERS else len(way) - 1
        if level >= H.LEVELS:
            continue
        away = sum(w.lean < 0 for w in way)
        total += (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - density(k)) * H.AWAY_FACTOR**away / (level + 1)
    total *= (1 - density(x)) * (H.AWAY_FACTOR if x.lean < 0 else H.TOWARDS_FACTOR if x.lean > 0 else 1)
    return total * (H.ARTICLE_FACTOR if x.tag in ("article", "main") and x.lean >= 0 else 1)


def test_points_are_those_of_a_plain_scorer(spark, sf):
    pages = [p for p, _ in made_pages(20)] + [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").limit(15).collect()]
    pages.append('<main><div><div class="note"><p>a, b</p></div><section>own, text<p>more</p><ul><li>x, y<li><a href=q>z</a></ul></section></div><div class="ad"><div><p>c, d, e</p></div></div></main>')
    for page in pages:
        _, nodes = H.parse(page)
        H._score(nodes)
        for x in nodes:
            if not x.gone:
                assert x.points == pytest.approx(slow_points(x), rel=1e-9, abs=1e-9)


def test_extract(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    got = H.extract(p.withColumn("text", F.lit("clash")).withColumn("N_Chars", F.lit(1)).withColumn("_text", F.lit("own")).withColumn("a.b", F.lit(2)))
    assert got.columns == ["page_id", "url", "_text", "a.b", "text", "n_chars"] and got.filter("n_chars <> char_length(text)").count() == 0 and got.filter("text = '' OR _text <> 'own'").count() == 0
    assert {r.text == H.main_text(r.html) for r in H.extract(p).join(p.select("page_id", "html"), "page_id").collect()} == {True}
    long = "<p>" + "word, " * 200_000 + "</p>"
    same = "<div><p>One, two.</p></div><div><p>Six, ten.</p></div>"  # what both are in has as many points as each, and comes first
    rows = [(1, "<div>" * 5000 + "<p>x, y</p>"), (2, None), (3, long), (4, same), (4, same), (5, "")]
    odd = spark.createDataFrame(rows, "page_id long, html string")
    assert [r.text for r in H.extract(odd).orderBy("page_id").collect()] == ["x, y", "", ("word, " * 200_000).strip(), "One, two. Six, ten.", "One, two. Six, ten.", ""]
    assert H.extract(odd.limit(0)).columns == ["page_id", "text", "n_chars"] and H.extract(odd.limit(0)).count() == 0


def test_language_model(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    edge = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (10**9 + 2, "x" * 5000 + " end")], DOCS)
    rows = d.select("doc_id", "text").union(edge)
    got = lm.score_texts(rows, max_training=150).toPandas()
    texts = {r.doc_id: r.text for r in rows.collect()}
    split = lambda t: (t or "").encode().lower().split()
    counts, n_texts = {}, 0
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            n_texts += 1
            for w in split(t):
                counts[w] = counts.get(w, 0) + 1
    total, v = sum(counts.values()) + n_texts, len(counts) + 1
    for r in got.itertuples():
        c = [counts.get(w, 0) for w in split(texts[r.doc_id])] + [n_texts]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(c), sum(x > 0 for x in c), total)
        assert r.base_score == pytest.approx(sum(math.log10((x + 1) / (total + v + 1)) for x in c)) and r.score < 0
    assert len(got) == len(texts)


def test_words_are_found_in_bulk_as_one_by_one():
    """Arrow parts and looks up all words of a batch; a small batch goes through a dictionary."""
    texts = [None, "", " ", "\x0b\x0c A\tB\nÉé\rx\x1cy z \x85 ", " a  b ", "\x0c", "b " * 90]
    values, n = lm.joined_words(texts)
    apart = [lm.words_of(t) for t in texts]
    assert values.to_pylist() == [w for d in apart for w in d] and n.tolist() == [len(d) for d in apart]
    n_ids = lm.Subwords(lm.DEFAULT_TOKENIZER).n_ids
    for more in (0, 2000):  # tables that are small and large beside the batch
        frequent = [("a", 3), ("b", 2)] + [(f"w{i}", 1) for i in range(more)]
        m = lm.add_counts(lm.new_model(*np.zeros((3, n_ids)), 1, lm.DEFAULT_TOKENIZER), frequent, 9 + more, 5 + more, 1)
        index, _, lengths, ends, ws, other = lm.place_words(texts, m)
        want = [{b"a": 0, b"b": 1}.get(w, -1) if w else -2 for d in apart for w in [*d, b""]]
        assert index.tolist() == want and lengths.tolist() == [len(d) + 1 for d in apart]
        assert ws == [w for d in apart for w in d if w not in (b"a", b"b")] and other.tolist() == [i for i, x in enumerate(want) if x == -1]


def by_token(m, vocabulary, total, distinct, text):
    """log10 probability of a text, one token after the other, each from its own window."""
    sub, table = lm.Subwords(m.tokenizer), {w: i for i, w in enumerate(m.words.split(b"\n"))} if m.words else {}

    def log_softmax(net, seq, at, window, context, inner):
        new = window - context
        start = max(0, at // new * new - context)
        p, k = net.p, "1" if inner else ""
        first = context - (at // new * new - start)  # the place in the window of the first id
        x = np.array([p["e" + k][c] + p["pos" + k][first + i] for i, c in enumerate(seq[start : at + 1])], dtype=float)
        w = np.array([math.exp(min(40, float((x[-1] @ p["q" + k]) @ (y @ p["k" + k])) / math.sqrt(lm.DIM))) for y in x])
        h = x[-1] + (w / w.sum()) @ (x @ p["v" + k]) @ p["o" + k]
        z = h @ (p["u1"] if inner else p["u0"]) + (p["b1"] if inner else p["b0"])
        return z - math.log(np.exp(z).sum())

    words = (text or "").encode().lower().split()
    cls = [int(m.word_class[table[w]]) if w in table else int(m.other_class[sub(w)[0]]) for w in words] + [lm.FREQUENT - 1]
    out, seq = 0.0, [m.BOS, *cls[:-1]]
    for i, c in enumerate(cls):
        lp = log_softmax(m.net, seq, i, lm.WINDOW, lm.CONTEXT, False)
        w = words[i] if i < len(words) else None
        n = vocabulary.get(w, 0) if w is not None else None
        base = 10**m.end_base if w is None else (n + 1) / (total + distinct + 1)
        if w is None:
            prob = math.exp(lp[c])
        elif w in table:
            prob = math.exp(lp[c]) * 10 ** m.word_log[table[w]]
        else:
            ids = sub(w)
            inner = [int(c), *[int(m.inner_class[x]) + lm.FIRST for x in ids[1:]]]
            spelled = float(m.other_log[ids[0]])
            for j in range(len(ids)):
                y = int(m.inner_class[ids[j + 1]]) if j + 1 < len(ids) else lm.INNER - 1
                q = log_softmax(m.net, inner, j, lm.INNER_WINDOW, lm.INNER_CONTEXT, True)[y]
                spelled += math.log((1 - lm.FLAT) * math.exp(q) + lm.FLAT * m.inner_share[y]) + (float(m.inner_log[ids[j + 1]]) if j + 1 < len(ids) else 0)
            outside = np.exp(lp[lm.FREQUENT :]).sum()
            prob = (1 - lm.COUNTED) * math.exp(lp[c] + spelled) + lm.COUNTED * n / max(1, m.n_other) * outside
        out += math.log10((1 - lm.BASE) * prob + lm.BASE * base)
    return out


def test_scores_are_those_of_a_loop_over_tokens(spark, monkeypatch):
    r = random.Random(8)
    common = [f"w{i}" for i in range(12)]
    texts = [" ".join(r.choice(common) if r.random() < 0.8 else "".join(r.choice(["qua", "zor", "bli", "é"]) for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 130))) for _ in range(40)] + [None, "", "Zz " * 70]
    kept = {}
    monkeypatch.setattr(lm, "fit_model", lambda *a, f=lm.fit_model, **k: kept.setdefault("m", f(*a, **k)))
    got = lm.score_texts(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    m, _, vocabulary, total, distinct, _ = kept["m"]
    counts = {x.word.encode(): x.c for x in vocabulary.collect()}
    for x in got:
        assert x.score == pytest.approx(by_token(m, counts, total, distinct, texts[x.doc_id]), rel=1e-4, abs=1e-3)


def test_language_model_edges(spark):
    clash = spark.createDataFrame([], DOCS + ", score string, _row int")
    assert lm.score_texts(clash).count() == 0
    rows = [(3, "a b", "x", 1), (3, "a b", "x", 1), (None, None, "y", 2), (2, "", "z", 3), (2**40, "long " * 20_000, "z", 3)]
    got = lm.score_texts(spark.createDataFrame(rows, DOCS + ", score string, _row int")).collect()
    assert len(got) == 5 and all(r.score < 0 for r in got) and len({r.score for r in got if r.doc_id == 3}) == 1
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    alone = lm.score_texts(spark.createDataFrame([(i, "only held out") for i in held], DOCS)).collect()
    assert len(alone) == len(held) and {r.train_tokens for r in alone} == {0} and {r.n_known for r in alone} == {0}


def test_language_model_learns_from_all_rows(spark):
    one, two = "red green blue pink ", "north east south west "
    rows = spark.createDataFrame([(i, (one if i % 2 else two) * 12 + f"odd{i}" * (i < 20)) for i in range(400)], DOCS)
    held = lm.score_texts(rows, max_training=1).filter("held_out AND doc_id >= 20").toPandas()
    each = held.score / held.n_tokens
    # The single text of the first steps has one of the two patterns; the other is learned from the rest.
    assert (each[held.doc_id % 2 == 0].mean() > -0.3) and (each[held.doc_id % 2 == 1].mean() > -0.3)
    texts = [f"common {'only ' * (i == 7)}" for i in range(40)]
    m = lm.fit_model(spark.createDataFrame(list(enumerate(texts)), DOCS), max_training=1, max_frequent=1)[0]
    sub = lm.Subwords(lm.DEFAULT_TOKENIZER)
    assert m.first_class[sub(b"common")[0]] == 0 and m.other_class[sub(b"only")[0]] == lm.FREQUENT and m.n_other == 1


def test_spelling_is_learned_at_every_size(spark):
    r = random.Random(5)
    often = [f"w{i}" for i in range(20)]
    texts = [" ".join(r.choice(often) for _ in range(30)) + " " + "".join(r.choice(["qua", "zor", "bli"]) for _ in range(4)) for _ in range(150)]
    m = lm.fit_model(spark.createDataFrame(list(enumerate(texts)), DOCS))[0]
    assert m.n_other > 0 and len(m.words.split(b"\n")) >= 20
    assert np.abs(m.net.p["b1"]).max() > 0.1 and (m.net.p["b0"][lm.FREQUENT :] > m.net.p["b0"][: lm.FREQUENT].min()).any()
    seen, odd = (m.encode([w], lm.Subwords(m.tokenizer)) for w in (b"quazorblizor", b"x7#kjq@vv!pw"))
    assert seen[0] > odd[0] + 5


def test_first_steps_are_not_on_the_driver(spark, monkeypatch):
    def train(*args, f=lm.train, **more):
        assert TaskContext.get() is not None, "the driver would hold the texts and their windows"
        return f(*args, **more)

    monkeypatch.setattr(lm, "train", train)
    rows = [(i, f"plain words odd{i} " * 9) for i in range(40)]
    m = lm.fit_model(spark.createDataFrame(rows + rows[:1], DOCS))[0]
    assert not lm._READY and np.abs(m.net.p["b0"]).max() > 0.1


def test_first_steps_are_in_order_and_leave_the_start_as_it_was(spark):
    texts = ["one two three " * 30, None, "four five six seven " * 20, "", "Eight one " * 40 + "nine"]
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], DOCS)
    n_ids = lm.Subwords(lm.DEFAULT_TOKENIZER).n_ids
    m = lm.add_counts(lm.new_model(*np.zeros((3, n_ids)), 1, lm.DEFAULT_TOKENIZER), [("four", 20), ("one", 70)], 300, 12, 5)
    start = {k: v.copy() for k, v in m.net.p.items()}
    got = lm.first_steps(df.orderBy(F.desc("doc_id")), spark.sparkContext.broadcast(m), m.net)
    kept = lm.train([texts[:2], texts[2:]], m, m.net)
    assert all((m.net.p[k] == v).all() for k, v in start.items()) and any((kept.p[k] != v).any() for k, v in start.items())
    for k, v in kept.p.items():
        np.testing.assert_allclose(got.p[k], v, rtol=1e-3, atol=1e-3)
    lm._READY.clear()


def test_inner_ids_seen_alike_share_their_logits_and_words_are_parted_once(spark, monkeypatch):
    net, r = lm.Attention.new(), np.random.default_rng(3)
    lengths = r.integers(1, 12, 300)
    inputs = r.integers(lm.FIRST, lm.FIRST + 3, lengths.sum())
    inputs[np.cumsum(lengths) - lengths] = r.integers(lm.FREQUENT, lm.FREQUENT + 2, len(lengths))
    target, rows = r.integers(0, lm.INNER, lengths.sum()), []
    monkeypatch.setattr(lm.Attention, "odds", staticmethod(lambda h, head, f=lm.Attention.odds: (rows.append(len(h)), f(h, head))[1]))
    got = lm.score_inner(net, inputs, target, lengths)
    assert sum(rows) < 0.8 * len(inputs)
    at, valid, counts = lm.windows(lengths, lm.INNER_WINDOW, lm.INNER_CONTEXT)
    z = net.states(inputs[at], valid, counts.shape[1], True)[counts] @ net.p["u1"] + net.p["b1"]
    places, want = at[:, lm.INNER_CONTEXT :][counts], z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    np.testing.assert_allclose(got[places], want[np.arange(len(z)), target[places]], rtol=1e-4, atol=1e-4)
    column = lm.packed_ids([[5, 6], [7], [1, 2, 3]])
    assert [x.tolist() for x in lm.unpacked_ids(column[1:])] == [[7, 1, 2, 3], [1, 3]] and len(lm.unpacked_ids(column[:0])[0]) == 0
    words = lm.with_ids(spark.createDataFrame([("été", 2), ("x" * 200, 1)], "word string, c long"), lm.DEFAULT_TOKENIZER).collect()
    sub = lm.Subwords(lm.DEFAULT_TOKENIZER)
    assert [np.frombuffer(w.ids, "<i4").tolist() for w in words] == [sub(w.word.encode()) for w in words]


def test_windows_score_every_id_once_and_gradients_are_right():
    lengths = np.array([1, 40, 33, 7, 100])
    at, valid, counts = lm.windows(lengths, 48, 16)
    seen = np.bincount(at[:, 16:][counts], minlength=lengths.sum())
    assert (seen == 1).all()
    net, r = lm.Attention.new(), np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    ids, ok = r.integers(0, lm.FIRST, (3, 8)), np.ones((3, 8), bool)
    ok[0, :2] = False
    target, weight = r.integers(0, lm.FIRST, (3, 5)), np.ones((3, 5))
    loss, g = net.gradient(ids, ok, target, weight, False)
    for k in ("e", "q", "v", "o", "u0"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.p[k][i] += 1e-5
        up, _ = net.gradient(ids, ok, target, weight, False)
        net.p[k][i] -= 1e-5
        assert (up - loss) / 1e-5 == pytest.approx(g[k][i], rel=2e-2)


def tune(r, notes=80, rate=4000):
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (r.integers(-12, 13) / 12) * np.arange(512) / rate) for _ in range(notes)]) * 0.5


def test_chroma_alignment(spark):
    r = np.random.default_rng(1)
    rate = 4000
    tunes = [tune(r) for _ in range(6)]
    rows = [(i, K.encode_wav(t, rate)) for i, t in enumerate(tunes)] + [(50, K.encode_wav(tunes[0], rate)), (60, None), (61, b"junk"), (62, K.encode_wav(np.zeros(4000), rate)), (63, K.encode_wav(np.zeros(40_000), rate))]
    media = spark.createDataFrame(rows, "id long, audio binary")
    prints = K.fingerprints(media)
    probes = K.fingerprints(K.excerpts(media.filter("id in (0, 3)"), start_seconds=20 * 0.128, seconds=5), phases=K.PHASES)
    got = {x.id: x for x in K.search(prints, probes).collect()}
    assert {i for i, x in got.items() if x.n_probes} == {0, 3, 50} and got[3].best_id == 3 and (got[3].best_offset, got[3].best_phase) == (20, 0) and got[3].best_error < 0.05
    assert got[50].class_id == 0 and got[0].class_size == 2 and got[50].best_id == 0
    assert [(got[i].n_frames, got[i].n_codes) for i in (60, 61)] == [(0, 0), (0, 0)] and got[62].n_codes == 0 and got[62].class_id == 62 and got[63].n_codes > 0
    assert K.search(prints.limit(0), probes).count() == 0 and K.search(prints, probes.limit(0)).filter("n_probes > 0").count() == 0
    off = K.fingerprints(K.excerpts(media.filter("id in (1, 2)"), start_seconds=2.624, seconds=5), phases=K.PHASES)
    assert {x.id for x in K.search(prints, off).collect() if x.n_probes} == {1, 2}


def aligned(probe, whole):
    """Phase, offset, hits and bit error of the best alignment, by trying every offset; None if it isn't good enough."""
    best = None
    for k, c in enumerate(probe):
        for o in range(-len(c) + 1, len(whole)):
            pairs = [(i, i + o) for i in range(len(c)) if 0 <= i + o < len(whole)]
            hits = sum(c[i] == whole[j] != K.SILENT and (i == 0 or c[i] != c[i - 1]) and (j == 0 or whole[j] != whole[j - 1]) for i, j in pairs)
            if hits >= 2 and (best is None or (hits, -k, -o) > best[:3]):
                wrong = sum(int(c[i] ^ whole[j]).bit_count() for i, j in pairs) / (32 * len(pairs))
                best = (hits, -k, -o, len(pairs), wrong)
    return best if best and best[3] >= K.MIN_OVERLAP and best[4] <= K.MAX_ERROR else None


def test_excerpts_from_anywhere_are_found_as_by_brute_force(spark):
    r, rate = np.random.default_rng(4), 4000
    tunes = [tune(r, 64) for _ in range(40)]
    media = spark.createDataFrame([(i, K.encode_wav(t, rate)) for i, t in enumerate(tunes)], "id long, audio binary")
    for noise, volume in ((0.01, 0.5), (0.03, 0.25)):
        probes = K.fingerprints(K.excerpts(media, seconds=5.12, noise=noise, volume=volume), phases=K.PHASES)
        found = K.align(probes, K.fingerprints(media)).collect()
        assert len({x.left_id for x in found if x.left_id == x.right_id}) >= 36  # of 40 random starts
        if noise == 0.01:
            whole = {x.id: [int(c) for c in x.codes] for x in K.fingerprints(media).collect()}
            part = {}
            for x in probes.collect():
                part.setdefault(x.id, {})[x.phase] = [int(c) for c in x.codes]
            got = {(x.left_id, x.right_id): x for x in found}
            for i in (0, 7, 20, 33):
                for j in (0, 7, 20, 33):
                    want, x = aligned([part[i][k] for k in sorted(part[i])], whole[j]), got.get((i, j))
                    assert (want is None) == (x is None)
                    if want:
                        assert (x.hits, x.phase, x.offset, x.overlap) == (want[0], -want[1], -want[2], want[3]) and x.bit_error == pytest.approx(want[4])


def test_silent_tails_and_drones_add_no_pairs(spark):
    r, rate = np.random.default_rng(5), 4000
    drone = np.sin(2 * np.pi * 220 * np.arange(40 * rate) / rate) * 0.5
    rows = [(i, K.encode_wav(np.concatenate([tune(r, 40), np.zeros(40 * rate) if i % 2 else drone]), rate)) for i in range(6)]
    prints = K.fingerprints(spark.createDataFrame(rows, "id long, audio binary"))
    assert min(x.n for x in prints.selectExpr("size(codes) as n").collect()) > 300
    assert max(x["count"] for x in K._places(prints, "right").groupBy("right_id").count().collect()) < 100


def test_chroma_edges(spark):
    empty = spark.createDataFrame([], "ID long, audio binary, code int, phase string")
    assert K.fingerprints(empty).count() == 0 and K.excerpts(empty, seconds=1).count() == 0
    wav = K.encode_wav(tune(np.random.default_rng(2), 700), 4000)  # 90 seconds
    rows = spark.createDataFrame([(1, wav, 5, "x"), (1, wav, 5, "x"), (2, wav, 6, "y"), (None, wav, 7, None)], "id long, audio binary, code int, phase string")
    got = K.search(K.fingerprints(rows), K.fingerprints(K.excerpts(rows, seconds=5), phases=2)).collect()
    assert [(x.id, x.class_id, x.class_size, x.n_probes, x.best_id) for x in sorted(got, key=lambda x: x.id)] == [(1, 1, 3, 1, 1), (1, 1, 3, 1, 1), (2, 1, 3, 1, 1)]
    vectors = spark.createDataFrame([(1, [0.1, float("nan"), None]), (2, None), (3, []), (None, [0.1])], "`v.id` long, v array<float>")
    assert {x.id: len(x.audio) for x in K.render_vectors(vectors, id_col="v.id", vector_col="v").collect()} == {1: 44 + 2 * 3 * 512, 2: 44, 3: 44}


def test_integral_image_filters_are_sums_of_rectangles():
    f = np.random.default_rng(2).random((K.SPAN, 12))
    code = int(K.codes(f)[0])
    kind, y, h, w = K.FILTERS[2]
    low, high = f[:w, y : y + h // 2].sum(), f[:w, y + h // 2 : y + h].sum()
    v = np.log((1 + high) / (1 + low))
    level = int(v > -K.CUT) + int(v > 0) + int(v > K.CUT)
    assert kind == 1 and (code >> (2 * 13)) & 3 == K.GRAY[int(level)] and 0 <= code < 2**32


def test_fold_is_crc32_of_the_id(spark):
    got = spark.createDataFrame([(i,) for i in (0, 7, 123456789)], "doc_id long").select("doc_id", fold(F.col("doc_id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


def test_least_by_hash_is_a_sort_of_all(spark):
    from tessera.llm.labelled import least_by_hash

    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    every = [r.doc_id for r in rows.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").collect()]
    for most in (50, 3_000, 15_000, 30_000):
        assert [r.doc_id for r in least_by_hash(rows, most, F.lit(3)).collect()] == every[:most]
    assert least_by_hash(rows.limit(0), 5).count() == 0
