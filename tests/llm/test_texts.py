"""Words, runs, language, quality, packing, extraction: against plain Python on small and awkward texts."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripmill.llm import common, extraction, langid, packing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "a b c d", "é\x0bü  x\x85y\xa0z", "one two three four five six", "日本 " * 50, "x" * 5000, "a b\n" * 300]


def test_words_and_runs():
    raw, offsets = common.text_bytes(pa.array(ODD))
    words, first = common.word_hashes(raw, offsets)
    expected = [WORD.findall(t or "") for t in ODD]
    assert np.diff(first).tolist() == [len(w) for w in expected]
    flat = [w for text in expected for w in text]
    assert len(set(words.tolist())) == len(set(flat))
    runs, owner = common.shingle_hashes(words, first, 5)
    plain = [(i, tuple(w[k : k + 5])) for i, w in enumerate(expected) for k in range(max(len(w) - 4, min(len(w), 1)))]
    assert owner.tolist() == [i for i, _ in plain]
    assert len(set(runs.tolist())) == len({run for _, run in plain})


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 9), (9, 1), (20, 21), (30, 30), *((100 + i, 101 + i) for i in range(40))]
    found = common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert dict((r["node"], r["component"]) for r in found) == {
        1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, **{100 + i: 100 for i in range(41)}
    }
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_gradients_are_those_of_the_loss():
    net = langid.fresh(["a", "b", "c"], 4, 2)
    raw = np.random.default_rng(0).integers(1, 255, 150).astype(np.uint8)
    windows, valid, _ = langid.windows_of(raw, np.array([0, 70, 150]))
    target = np.array([0, 1, 2, 1])[: len(windows)]
    _, slopes = langid.gradients(net, windows, valid, target)
    for weights, slope in zip(net.weights, slopes, strict=True):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        kept = weights[at]
        sides = []
        for step in (1e-2, -1e-2):
            weights[at] = kept + step
            sides.append(langid.gradients(net, windows, valid, target)[0])
        weights[at] = kept
        assert slope[at] == pytest.approx((sides[0] - sides[1]) / 2e-2, rel=0.02)


def test_language_of_held_out_texts(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    found = langid.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.95
    assert found["score"].between(0, 1).all()


def test_language_of_awkward_rows(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    net = langid.learn(docs, per_language=20, steps=20)
    odd = spark.createDataFrame([(i, t, "src") for i, t in enumerate([*ODD, "12 34 !!", "12 34 !!"])], "doc_id bigint, text string, score string")
    found = {r["doc_id"]: r for r in langid.identify(odd, net).collect()}
    assert len(found) == len(ODD) + 2
    assert {found[i]["lang_pred"] for i in (0, 1, 2, 10, 11)} == {"und"} and found[0]["score"] == 0
    assert found[3]["lang_pred"] in net.labels
    empty = docs.limit(0)
    assert langid.learn(empty) is None and langid.identify(odd, None).filter("lang_pred <> 'und'").isEmpty()
    assert langid.keep_identified(empty).columns == docs.columns


def test_quality_of_held_out_texts(spark, sf_dir):
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    found = quality.quality_query(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    assert (found["predicted"] == found["quality"]).mean() > 0.93
    assert ((found["score"] >= 0.7) == (found["predicted"] == 1)).all()
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    scores = {r["doc_id"]: r["score"] for r in quality.rate(odd, quality.learn(docs, labels)).collect()}
    assert len(scores) == len(ODD) and scores[0] == scores[1] and all(0 <= s <= 1 for s in scores.values())
    assert quality.learn(docs, labels.filter("quality = 1")) is None
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()


def test_pairwise_ranking_prefers_what_is_preferred():
    random = np.random.default_rng(1)
    raw = random.standard_normal((400, quality.N_FEATURES))
    label = (raw[:, 0] + 0.1 * random.standard_normal(400) > -0.5).astype(int)
    ranker = quality.fit(raw, label, float((label == 0).mean()))
    score = ranker.score(raw)
    assert ((score >= quality.CUT) == (label == 1)).mean() > 0.93
    assert np.corrcoef(score, raw[:, 0])[0, 1] > 0.6


@pytest.mark.parametrize("length", [1, 2, 63, 100, 1365, 1366, 2047, 2048, 2049, 3000, 4095, 4096, 4097, 20000])
def test_cuts(length):
    pieces = packing.cuts(length)
    assert sum(size for size, _ in pieces) == length
    for size, kind in pieces:
        assert 0 < size <= 4096 // kind and size >= 0.97 * (4096 // kind)


def test_encoder_equals_the_tokenizer():
    coder = packing.Encoder(packing.tokenizer_file(), remember=50)
    texts = [t or "" for t in ODD] + ["Don't I'LL it's 'S", "a<|endoftext|>b <|startoftext|>", "ΑΣ, İx ﬁ ẞ ab... ?!", "a\x01b \x01 c", "é é ́x", "x% word*** _y_ 12,5"] * 2
    for text in texts:
        assert coder.ids(text.encode()).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_of_letters_go_to_the_merges_directly(monkeypatch):
    letters = [chr(point) for point in range(0x250) if chr(point).isalpha()] + ["\u212a", "\u212b", "\u0345", "ﬀ"]
    choose = random.Random(5)
    words = ["".join(choose.choices(letters if n % 3 else letters[:117], k=choose.randint(1, 12))) + choose.choice(["", ".", "?!"]) for n in range(3000)]
    texts = [" ".join(words[at : at + 30]) for at in range(0, len(words), 20)]  # neighbours share words
    wanted = packing.Encoder(packing.tokenizer_file()).tokenizer
    for remember in (50, 80 << 20):
        found = packing.Encoder(packing.tokenizer_file(), remember).ids_of([t.encode() for t in texts])
        assert [ids.tolist() for ids in found] == [wanted.encode(t, add_special_tokens=False).ids for t in texts]
    coder, calls = packing.Encoder(packing.tokenizer_file()), []
    monkeypatch.setattr(coder, "plain", lambda text: calls.append(text) or wanted.encode(text, add_special_tokens=False).ids)
    for at in range(0, 3000, 20):
        coder.ids(" ".join(word.lower().rstrip(".?!") for word in words[at : at + 20] if word.isascii() or max(word) <= "\xff").encode())
    assert not calls and coder.weight == sum(len(word) + len(ids) + coder.ENTRY for word, ids in coder.young.items())


def test_packing_keeps_every_token(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text").limit(150)
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    both = docs.unionByName(odd).withColumn("offset", F.lit("clash"))
    rows = packing.pack(both).toPandas()
    coder = packing.Encoder(packing.tokenizer_file())
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    assert set(rows["doc_id"]) == set(texts)
    for doc, part in rows.sort_values("start").groupby("doc_id"):
        ids = np.append(coder.ids((texts[doc] or "").encode()), np.uint32(2)).astype("<u4")
        at = 0
        for piece in part.itertuples():
            assert piece.start == at and piece.doc_tokens == len(ids)
            assert piece.ids_crc32 == zlib.crc32(ids[at : at + piece.length].tobytes())
            at += piece.length
        assert at == len(ids)
    used = padded = 0
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        size = int(part["length"].sum())
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]] and size <= 4096
        kind = int(part["piece_class"].iloc[0])
        assert kind == 0 or len(part) == kind  # a class's sequences hold a fixed number of pieces
        used, padded = used + size, padded + (0 if size & (size - 1) == 0 else 4096 - size)
    assert padded < 0.03 * used
    assert packing.pack(docs.limit(0)).count() == 0


PAGE = (
    '<html><head><title>T</title></head><body><header>Site</header><nav><a href="/x">menu one two three four</a></nav>'
    '<div id="cookie-notice">accept all of our cookies now please thank you</div><article><h1>Head &amp; more</h1>'
    "<p>First <b>bo</b>ld  text&nbsp;here.<script>var x = '<p>no</p>';</script><p>a<br>b<!-- hidden words --></p><div class=\"comments\">nice one</div>"
    "<p>Last.</article><aside>related links</aside><form>mail <input></form><footer>imprint and much other text of no use here</footer></body></html>"
)


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "v", None, "x"), (3, "w", "", "x"), (4, None, "<p", "x"), (5, "t", "plain &lt;words&gt;", "x"), (5, "t", "plain &lt;words&gt;", "x")], "page_id bigint, url string, html string, text string")
    found = [(r["page_id"], r["text"], r["n_chars"]) for r in extraction.extract_pages(pages).orderBy("page_id").collect()]
    assert found[0][1] == "Head & more First bold text here. a b Last."
    assert [text for _, text, _ in found[1:4]] == ["", "", "<p"]
    assert [text for _, text, _ in found[4:]] == ["plain <words>"] * 2
    assert all(n == len(text) for _, text, n in found)
    assert extraction.extract_pages(pages.limit(0)).count() == 0


def test_best_run_is_the_largest_sum():
    random = np.random.default_rng(3)
    for _ in range(50):
        page = "".join(random.choice(["<p>", "</p>", "<li>", "</li>", "w ", "w w ", "<b>"], 12))
        made = extraction.outline(page)
        value = [extraction.weight({}, k, n) * (len(t.split()) if k == "text" else 1) for k, n, t in made]
        best = max((sum(value[i:j]) for i in range(len(value)) for j in range(i + 1, len(value) + 1)), default=0)
        got = extraction.extract(page, {}).split()
        assert (best > 0) == bool(got)


def test_extraction_of_whole_articles(spark, sf_dir):
    import html as h

    pages = common.table(spark, sf_dir, "pages")
    found = {r["page_id"]: r["text"] for r in extraction.extract_pages(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.S).group(1)
        assert found[row["page_id"]] == " ".join(h.unescape(re.sub(r"</?(?:p|h1|br)>", "\n", re.sub("</?b>", "", inner))).split())


def test_wrappers_do_not_lose_the_article():
    article = "<p>" + "Words of the story go on. " * 30 + "</p>"
    plain = " ".join(("Words of the story go on. " * 30).split())
    side = '<div class="sidebar">links and links</div>'
    for page in (
        f'<body><div class="content-sidebar-wrap"><main>{article}</main>{side}</div></body>',
        f'<body><div id="page" class="site has-sidebar"><div>{article}</div>{side}</div></body>',
        f"<body><form><div>{article}</div></form></body>",
        f'<body><div class="has-sidebar"><article class="post">{article}</article><div class="comments"><article>so good</article></div></div></body>',
    ):
        assert extraction.extract(page, {}) == plain
    inner = "<math>x y</math> <audio>no sound</audio> <object>an object</object> <menu><li>soup</li></menu>"
    assert extraction.extract(f"<article>{article}{inner}{article}</article>", {}) == f"{plain} x y no sound an object soup {plain}"
    assert extraction.weight({"mark:rail": -3.0}, "open", "div rail wide") == -4.0
    assert extraction.weight({}, "open", "div sidebar") < extraction.weight({}, "open", "div wide")


def test_threshold_is_a_quantile_of_all_learning_rows(spark):
    random = np.random.default_rng(4)
    good = random.integers(0, 2, 1200)
    texts = [" ".join(random.choice(["word", "#", "two,", "Three", "4"], 60, p=[0.3, 0.3 - 0.06 * g, 0.2, 0.1 + 0.06 * g, 0.1])) for g in good]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id bigint, quality int")
    ranker = quality.learn(docs, labels, per_label=60)
    below = (ranker.score(quality.matrix(texts)) < quality.CUT).mean()
    assert abs(below - (good == 0).mean()) < 0.01
