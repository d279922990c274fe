"""Classifiers, extraction and deobfuscation."""

import itertools
import random
import time
import zlib

import numpy as np
import pandas as pd
import pytest
import zstandard

from ringscope.llm import html_extract, labelled, quality_classifier, toxicity, training_pages


def word(rng, n=3):
    return "".join(rng.choice(["ba", "no", "ti", "ra", "se", "lo"]) for _ in range(rng.randint(1, n)))


def prose(rng, n=80):
    return " ".join(word(rng) for _ in range(n))


def test_quality_by_compression():
    rng = random.Random(1)
    good = [prose(rng) for _ in range(120)]
    bad = [" ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in prose(rng).split()) for _ in range(120)]
    y = np.array([1.0] * 80 + [0.0] * 80)
    model = quality_classifier.fit(good[:80] + bad[:80], y)
    s = model.score(good[80:] + bad[80:] + ["", None, "x" * 200_000])
    assert (s[:40] >= 0.5).mean() > 0.95 and (s[40:80] < 0.5).mean() > 0.95
    assert ((0 <= s) & (s <= 1)).all() and s[80] == s[81] == pytest.approx(0.5)


def test_classifier_without_labels():
    assert quality_classifier.fit([], np.zeros(0)).score(["a", None]).tolist() == [0.5, 0.5]
    assert quality_classifier.fit(["a", "b"], np.ones(2)).score(["a"])[0] > 0.99
    assert toxicity.fit([], np.zeros(0)).score(["a", None]).max() < 0.5


@pytest.fixture(scope="module")
def toxic_model():
    rng = random.Random(2)
    nasty = ["idiot", "moron", "stupid", "pathetic"]
    clean = [prose(rng, 60) for _ in range(300)]
    bad = []
    for _ in range(150):
        w = prose(rng, 60).split()
        for _ in range(3):
            w[rng.randrange(60)] = rng.choice(nasty)
        bad.append(" ".join(w))
    return toxicity.fit(clean + bad, np.array([0.0] * 300 + [1.0] * 150))


@pytest.mark.parametrize("disguised", ["1d10t", "i d i o t", "i.d.i.o.t", "iiidioot", "m0r0n", "5tup1d", "s-t-u-p-i-d", "p@thetic", "STUPIIIID!!", "*idiot*", "p a t h e t i c"])
def test_deobfuscation(toxic_model, disguised):
    rng = random.Random(5)
    assert toxicity.restore(disguised, toxic_model.lm).strip() in {"idiot", "moron", "stupid", "pathetic"}
    text = prose(rng, 30) + " " + disguised + " " + prose(rng, 30)
    assert toxic_model.score([text])[0] >= 0.5


def test_clean_texts_stay_clean(toxic_model):
    rng = random.Random(6)
    texts = [prose(rng, 50) for _ in range(50)] + ["", None, "call 555 1234 at 10:30", "a b c d e f", "$$$ *** %%%", "x" * 300_000]
    assert (toxic_model.score(texts) < 0.5).all()


def test_score_columns(spark, toxic_model):
    df = spark.createDataFrame([(1, "stupid idiot", "x"), (2, None, "y")], "doc_id long, text string, score string")
    rows = {r.doc_id: r.score for r in toxicity.score_toxicity(df, toxic_model).collect()}
    assert rows[1] > 0.5 > rows[2]
    assert toxicity.score_toxicity(df.limit(0), toxic_model).count() == 0


def test_labelled_sample_is_bounded_and_respects_folds(spark):
    docs = spark.createDataFrame([(i // 2, f"text {i}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, quality int")
    texts, y, share = labelled.sample_labelled(docs, labels, "quality", 3, 1, 50)
    assert 10 < (y == 1).sum() < 100 and len(texts) == len(y) and share == pytest.approx(0.5, abs=0.05)
    assert all(labelled.fold_of(int(t.split()[1]) // 2, 3) != 1 for t in texts)


def test_toxic_model_counts_every_labelled_text(spark):
    """7,000 texts of both labels: word counts, lexicon and curve equal those of the lists."""
    rng = random.Random(4)
    rows = [(k, f"{prose(rng, 3)} {' '.join(c + ''.join(chr(97 + int(d)) for d in str(k)) for c in 'uvwxyz')} {rng.choice(['idiot', 'moron', 'm0r0n', 'ba']) if k % 2 else ''}", k % 2) for k in range(7000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_from(docs.select("doc_id", "text"), labels)
    used = [(t, float(y)) for k, t, y in rows if labelled.fold_of(k, 5) != 0]
    lowered, y = [t.lower() for t, _ in used], np.array([y for _, y in used])
    lead = toxicity._leaders(lowered, y)
    lowered, y = [lowered[k] for k in lead], y[lead]
    words = [toxicity._letters.findall(t) for t in lowered]
    plain = toxicity.CharModel.fit(toxicity.Counter(w for ws in words for w in ws))
    assert len(lead) > 5300 and model.lm.counts == plain.counts and model.lm.alphabet == plain.alphabet
    lexicon = toxicity._lexicon([set(ws) for ws in words], y)
    strong = lambda known: {k: v for k, v in known.items() if v > 0}
    assert strong(model.lexicon) == pytest.approx(strong(lexicon)) and "moron" in model.lexicon and set(model.lexicon) >= set(lexicon)
    assert (model.score(["ti se moron", "m0r0n"]) > 0.5).all() and model.score(["ti se ra", ""]).max() < 0.5


def test_toxic_model_takes_every_different_text_and_word(spark):
    """31,000 words of one text each enter the language model; texts that only share the words
    of least hash are no copies, those that only differ in case and white space are."""
    texts = ["ba no ti idiot", "BA  no\tti idiot", *(f"ba no ti ra se lo {'idiot' if k % 2 else 'ra'} w{chr(97 + k % 26)}{'abcdefghij'[k // 26 % 10]}" for k in range(200))]
    y = np.array([1.0, 1.0, *(k % 2 for k in range(200))])
    rows = [(k, t, int(v)) for k, (t, v) in enumerate(zip(texts, y, strict=True))]
    lead = toxicity.leaders(spark.createDataFrame([(k, v, k % 2, t) for k, t, v in rows], "_id long, y int, half int, text string")).collect()
    assert sorted(r._id for r in lead) == toxicity._leaders([t.lower() for t in texts], y) == [0, *range(2, 202)]
    words = toxicity.Counter({"x" + "".join(chr(97 + int(d)) for d in str(k)): 1 for k in range(31_000)})
    lm = toxicity.CharModel.fit(words)
    assert lm.counts[" "] == 31_000
    found = toxicity.counted_sequences(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r.key: r.n for r in found} == lm.counts


def test_quality_model_learns_from_every_labelled_text(spark):
    """Dictionaries of many groups, merged twice; the curve of all rows of the other half."""
    rng = random.Random(8)
    rows = [(k, prose(rng, 60) if k % 2 else " ".join(w + rng.choice(["***", "$$$"]) for w in prose(rng, 40).split()), k % 2) for k in range(1500)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    model = quality_classifier.fit_from(docs.select("doc_id", "text"), labels, group_bytes=4000, fan=8)
    texts, share = labelled.labelled_texts(docs.select("doc_id", "text"), labels, "quality", 3, 1)
    got = texts.collect()
    assert sorted(r["_id"] for r in got) == [k for k, _, _ in rows if labelled.fold_of(k, 3) != 1] and model.default == pytest.approx(share)
    rest = [r for r in got if r["half"] == 1]
    y = np.array([float(r["y"]) for r in rest])
    assert model.weights == pytest.approx(labelled.fit_logistic(model.features([r["text"] for r in rest]), y, 1e-4), rel=1e-4, abs=1e-5)
    held = [(t, y) for k, t, y in rows if labelled.fold_of(k, 3) == 1]
    assert ((model.score([t for t, _ in held]) >= 0.5) == np.array([y == 1 for _, y in held])).mean() > 0.95
    one = quality_classifier.fit_from(docs.select("doc_id", "text"), labels.where("quality = 1"))
    assert one.score(["a"])[0] > 0.99 and quality_classifier.fit_from(docs.select("doc_id", "text"), labels.limit(0)).score(["a", None]).tolist() == [0.5, 0.5]


def test_viterbi_and_marginals_against_enumeration():
    """All labellings of short chains: the best one, the likelihood and its gradient."""
    rng = np.random.default_rng(3)
    field = html_extract.Field({f"f{k}": tuple(rng.normal(size=2)) for k in range(4)}, rng.normal(size=(2, 2)))
    for n in (1, 2, 5):
        u = rng.normal(size=(n, 2))
        field.scores = lambda blocks, u=u: u
        score = lambda y, u=u: sum(u[k, a] for k, a in enumerate(y)) + sum(field.step[a, b] for a, b in zip(y, y[1:], strict=False))
        assert tuple(field.decode([None] * n)) == max(itertools.product((0, 1), repeat=n), key=score)
    lengths, nf = [1, 3, 4], 3
    x = rng.integers(0, 2, size=(3, 4, nf)).astype(float)
    y = rng.integers(0, 2, size=(3, 4))
    mask = np.array([[float(k < n) for k in range(4)] for n in lengths])
    gold = np.eye(2)[y] * mask[..., None]

    def brute(theta):
        w, step = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        total = 0.0
        for p, n in enumerate(lengths):
            u = x[p] @ w
            score = lambda labels, u=u: sum(u[k, a] for k, a in enumerate(labels)) + sum(step[a, b] for a, b in zip(labels, labels[1:], strict=False))
            total += score(y[p, :n].tolist()) - np.logaddexp.reduce([score(c) for c in itertools.product((0, 1), repeat=n)])
        return total / 3 - 0.05 * theta @ theta

    theta = rng.normal(size=2 * nf + 4)
    value, grad = html_extract.likelihood(theta, x, gold, mask, 0.1)
    assert value == pytest.approx(brute(theta))
    for k, e in enumerate(np.eye(len(theta)) * 1e-5):
        assert grad[k] == pytest.approx((brute(theta + e) - brute(theta - e)) / 2e-5, abs=1e-6)


def test_field_on_kinds_of_pages_it_has_not_seen():
    kinds, shares = training_pages.KINDS, {}
    for kind in kinds:
        field = html_extract.fit(html_extract.labelled_pages(140, kinds=tuple(k for k in kinds if k != kind)), steps=80)
        pages = html_extract.labelled_pages(30, 123, (kind,))
        shares[kind] = sum(a == b for blocks, y in pages for a, b in zip(field.decode(blocks), y, strict=True)) / sum(len(y) for _, y in pages)
    assert min(shares.values()) > 0.75 and sum(shares.values()) / len(shares) > 0.93, shares


#: Pages written by hand, with the main text that a reader would take.
BY_HAND = [
    ("<body><div id=nav><a href=/>Home</a> <a href=/a>About us</a></div><div id=article><h2>Rain at last</h2><p>It rained for two days and the river rose by a foot.<p>Nobody was hurt, the mayor said.</div><div class=footer>© The Courier</div>",
     "Rain at last\n\nIt rained for two days and the river rose by a foot.\n\nNobody was hurt, the mayor said."),
    ("<html><head><title>x</title><body><main><h1>How to sharpen a chisel</h1><ol><li>Flatten the back.<li>Grind the bevel to 25 degrees.</ol></main><aside><h3>More</h3><ul><li><a href=1>Planes</a><li><a href=2>Saws</a></ul></aside>",
     "How to sharpen a chisel\n\nFlatten the back.\n\nGrind the bevel to 25 degrees."),
    ("<header><nav><ul><li><a href=/>Start</a></ul></nav></header><article><h1>Soup</h1><p>Boil the onions slowly until they are soft, then add the stock.</p><div class=advertisement>Buy pans now</div><p>Serve with bread.</p></article><section id=comments><h3>2 comments</h3><div class=comment><p>Lovely, I made it twice already.</p></div></section>",
     "Soup\n\nBoil the onions slowly until they are soft, then add the stock.\n\nServe with bread."),
]


@pytest.mark.parametrize(("page", "text"), BY_HAND)
def test_pages_by_hand(page, text):
    assert html_extract.trained().main_text(page) == text


@pytest.mark.parametrize("piece", ['<a "', "<svg>", "<b>", "<div></x>", "<b><input>", "<p>x</p>", '<a href="x', "<!--", "<select>", "<input>", "<a <a "])
def test_time_grows_with_the_length(piece):
    began = time.perf_counter()
    html_extract.leaf_blocks(piece * 60_000)
    html_extract.leaf_blocks("<select><table>" + "<div>" * 20_000 + piece * 40_000 + '">')
    assert time.perf_counter() - began < 15  # minutes if each piece read on to the end


@pytest.mark.parametrize(("page", "texts"), [
    ("<table><thead><tr><td>a<tbody><tr><td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("<p>a<b>b<p>c</b>d<div>e</div>", ["ab", "cd", "e"]),
    ('<a href="x>one</a><p>two</p>', ["one", "two"]), ("<a href=\"x>one</a><p class='y>z'>two</p>", ["one", "two"]), ("&am<b>p;</b> x", ["&amp; x"]),
    ("<p hidden>no</p><p style='color: red; display: none'>no</p><p class='hidden'>a</p><p title='x hidden y'>b</p>", ["a", "b"]), ("a < b <3 </> c", ["a < b <3 </> c"]), ("<select><optgroup><option>a<option>b</select>c", ["c"]),
])
def test_implied_ends_and_loose_tags(page, texts):
    assert [b.text for b in html_extract.leaf_blocks(page)] == texts


PROSE = ["The old mill stood by the river for two hundred years before the flood took it.", "Nobody in the village could say who had built it, or why.", "On Sundays the children walked up the hill to look at the ruins.", "It was raining."]


@pytest.mark.parametrize("page", ["<html><body>{}</body></html>", "<body>{}", "{}", "<div>{}</div>", "<html><head><title>x</title></head><body>{}</body></html>", "<table><tr><td>{}</td></tr></table>", "<article>{}</article>"])
def test_paragraphs_alone_are_the_text(page):
    for n in (1, 2, 3, 5, 10, 30):
        texts = [f"{PROSE[k % 4]}{k % 3 or ''}" for k in range(n)]
        assert html_extract.trained().main_text(page.format("".join(f"<p>{t}</p>" for t in texts))).split("\n\n") == texts


@pytest.mark.parametrize("end", ["", "<p>The end.</p>", "<ul><li>One thing to remember.</li></ul>", "<h2>Notes</h2><p>See above.</p>"])
def test_comments_and_footers_after_an_article_go(end):
    article = f"<article><h1>The mill</h1>{''.join(f'<p>{t}</p>' for t in PROSE)}{end}</article>"
    whole = html_extract.trained().main_text(article)
    for n in (1, 2, 5):
        after = f"<section id=comments>{''.join(f'<p>Great post, thanks a lot {k}</p>' for k in range(n))}</section>"
        assert html_extract.trained().main_text(article + after) == whole
    assert html_extract.trained().main_text(article + "<footer>c</footer>") == whole


def test_blocks_and_entities():
    page = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four<p>caf&eacute; &#x41; 1 < 2</article><footer>&copy; x</footer>"
    assert [b.text for b in html_extract.leaf_blocks(page)] == ["Home", "A & B", "one two three four", "café A 1 < 2", "© x"]
    assert html_extract.trained().main_text(page) == "A & B\n\none two three four\n\ncafé A 1 < 2"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "</div></div>", "<script>", "plain", "<a href='", "<p>" * 3000, "<" * 5000, "<div \"" * 2000])
def test_broken_markup(page):
    assert isinstance(html_extract.trained().main_text(page), str)


def test_extract_column(spark):
    df = spark.createDataFrame(pd.DataFrame({"page_id": [1, 2], "html": ["<article><p>Some words here.</p></article>", ""], "text": ["old", "old"]}))
    assert {r.page_id: r.text for r in html_extract.extract_text(df).collect()} == {1: "Some words here.", 2: ""}


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><body><p>text</p>", "<head><meta charset=utf-8><p>text</p>", "<head><title>T</title>text", "<div><svg><path d=x><p>text</p></div>",
    "<svg><foreignObject><p>no</p></foreignObject></svg><p>text</p>", "<svg><path><p>text</p><svg></svg>", "<select><option>no<input></select><p>text</p>", "<select><option>no<select><p>text",
    "<select><option>no<input>text", "<button>no<button>no</button>text",
])
def test_optional_end_tags(page):
    assert [b.text for b in html_extract.leaf_blocks(page)] == ["text"]


def test_decoding_against_all_readings(toxic_model):
    """The reading of least cost among all, on random disguised tokens and spaced runs."""
    rng, lm = random.Random(0), toxic_model.lm

    def best(token):
        found = []
        for arcs in itertools.product(*toxicity.lattice(token)):
            at, total = "   ", 0.0
            for piece, extra in arcs:
                total += extra
                for c in piece:
                    if c == " " and at[-1] == " ":
                        continue
                    total += lm.cost(at, c)
                    at = "   " if c == " " else at[1:] + c
            found.append((total + lm.cost(at, " "), tuple(p for p, _ in arcs)))
        return "".join(min(found)[1])

    tokens = ["".join(rng.choice("abeiost013@$!*.- ") for _ in range(rng.randint(1, 7))) for _ in range(250)] + ["***", "a*b*c", "1d10t", "i d i o t"]
    assert [toxicity.decode(t, lm) for t in tokens] == [best(t) for t in tokens]


def test_decoding_takes_time_by_length(toxic_model):
    began = time.perf_counter()
    assert len(toxicity.decode(" ".join("idot1@"[k % 6] for k in range(60_000)), toxic_model.lm)) >= 50_000
    assert time.perf_counter() - began < 40


def test_compression_score_against_plain_formula(spark):
    """Scores through Spark equal a plain computation, row for row; nulls, repeats, ties."""
    rng = random.Random(9)
    texts = [prose(rng, 90) for _ in range(60)] + [prose(rng, 90).replace("a", "#") for _ in range(60)]
    model = quality_classifier.fit(texts, np.array([1.0] * 60 + [0.0] * 60), 0.7)

    def plain(text):
        if not text or not text.strip():
            return 0.7
        data = text.encode()
        n = max(1, round(len(data) / 1024))
        parts = [data[k * 1024 : (k + 1) * 1024 if k < n - 1 else None] for k in range(n)]
        g, b = (sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False).compress(p)) for p in parts) for d in (model.good, model.bad))
        diff, ratio = 2 * (b - g) / (b + g), (b + g) / (2 * len(data) + 8)
        z = np.dot(model.weights, [diff, ratio, diff * abs(diff) * 4, abs(diff) * ratio, 1])
        return 1 / (1 + np.exp(-z))

    rows = [(k % 50 if k % 7 else None, t, "s") for k, t in enumerate([*texts[:70], None, "", " \n", "x" * 100_000, texts[0], texts[0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = quality_classifier.score_quality(df, model).collect()
    assert [r.score for r in got] == pytest.approx([plain(r.text) for r in got])
    assert quality_classifier.score_quality(df.limit(0), model).count() == 0


@pytest.mark.parametrize(("op", "sf", "column", "folds", "held", "floor"), [(quality_classifier.op3_quality_classifier, "sf0.01", "quality", 3, 1, 0.85), (toxicity.op10_toxicity, "sf0.1", "toxic", 5, 0, 0.85)])
def test_held_out_ranking(spark, op, sf, column, folds, held, floor):
    """Area under the curve on labelled rows of the fold that was held out; at sf0.1 where
    the fold of sf0.01 has six rows of label 1."""
    sf = f"/root/testdata/{sf}"
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and r.predicted == int(r.score >= 0.5) for r in rows)
    side = {y: [r.score for r in rows if r.held_out and labels.get(r.doc_id) == y] for y in (0, 1)}
    area = np.mean([(a > b) + (a == b) / 2 for a in side[1] for b in side[0]])
    assert area > floor, area
