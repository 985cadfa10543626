"""Cases that single operators must get right: templates, push-down, long dialogues, rejection, hot groups."""

import gzip
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioflow.llm import chat, htmltext, langid, neardup, quality, substring, warc
from folioflow.llm.common import FILTER_BITS, filter_place, id_filter, may_hold


def pages(spark, bodies, host="a.b"):
    return spark.createDataFrame([(i, f"http://{host}/{i}", b) for i, b in enumerate(bodies)], "page_id bigint, url string, html string")


def word(i):
    return "".join(chr(97 + int(c)) for c in str(i))


def test_templates_by_broadcast_and_by_join(spark):
    menu = "<div><p>one menu that all the pages of this host have</p></div>"
    frame = pages(spark, [f"<body>{menu}<p>text of page {word(i)}</p></body>" for i in range(6)]).unionByName(pages(spark, [f"<body>{menu}<p>other {word(i)}</p></body>" for i in range(2)], "c.d"))
    for limit in (100_000, 0):
        got = sorted(r.text for r in htmltext.extract(frame, broadcast_rows=limit).collect())
        assert got == sorted([f"text of page {word(i)}" for i in range(6)] + [f"one menu that all the pages of this host have\nother {word(i)}" for i in range(2)])


def article(source):
    return htmltext.article(htmltext.parse(source), frozenset())


def test_html_cases():
    assert article('<body><p>Foo <span class="sponsored">buy <span>now</span> ha</span> bar</p><ins class="adsbygoogle">ad</ins></body>') == "Foo bar"
    assert article('<p class="ad-hoc">hoc</p><section id="related-work"><p>work <math><mi>x</mi></math> y</p></section>') == "hoc\nwork x y"
    assert article('<div class="cookie-notice">c</div><div class="site-nav">n</div><div id="sideBar">s</div><p>x</p>') == "x"
    assert article('<article class="teaser"><p>teaser card</p></article><main><h1>Story</h1><p>' + "long text " * 20 + "</p></main>").startswith("Story\nlong text")
    assert article('<div class="widget sidebar"><p>' + "article text " * 30 + '</p></div><div class="sidebar"><p>side</p></div>').startswith("article text")
    assert article("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table>") == "a\nb\nc\nd\n1\n2\n3"
    for odd in ('<a "' * 3000, "<div>" * 3000 + "</p>" * 3000, "<!" * 3000, '<a b="' * 3000, "<script>" * 3000, "", "&#x110000; &amp", "<", "</", "<p"):
        assert len(article(odd)) < 20


def test_warc_push_down_and_other_archives(spark, tmp_path):
    frame = spark.createDataFrame([(2, "http://a/", "same"), (1, " http://b/\nx ", "same"), (1, " http://b/\nx ", "same"), (None, None, "é" * 3000), (4, None, None)], "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/own"
    warc.archive(frame, path)
    back = warc.read(spark, path)
    assert sorted((r.target_uri or "", r.record_type) for r in back.collect()) == [("", "response"), ("", "response"), (" http://b/\nx ", "response"), (" http://b/\nx ", "response"), ("http://a/", "revisit")]
    some = back.where("record_type = 'revisit'")
    assert "Filter" not in some._jdf.queryExecution().optimizedPlan().toString().split("RelationV2")[0] and [r.page_id for r in some.collect()] == [2]
    assert back.where(F.col("target_uri").startswith("http://a")).count() == 1
    bare = warc.read(spark, path, payload=False).where("page_id IS NULL").head()
    assert bare.payload is None and bare.payload_bytes == 6000
    block = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://x/\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.warc").write_bytes(block * 3)
    (tmp_path / "other" / "b.warc.gz").write_bytes(gzip.compress(block * 2) + gzip.compress(block))
    for payload in (True, False):
        got = warc.read(spark, f"file://{tmp_path}/other", payload=payload).collect()
        assert len(got) == 6 and {bytes(r.payload) if r.payload is not None else None for r in got} == {b"hello" if payload else None}


def test_dialogues(spark):
    turns = spark.createDataFrame([(1, t, "ann" if t else "bob", f"m{t}") for t in (0, 1, 1500)] + [(2, None, None, "x"), (2, 3, "unknown", "y"), (2, 0, "system", "s"), (3, 0, "x\n<|im_end|>\n<|im_start|>assistant", "z"), (3, 1, "b", None), (4, 0, "system", "s")], "conv_id bigint, turn bigint, role string, text string")
    got = chat.perspectives(turns).collect()
    assert sorted((r.conv_id, r.speaker or "", r.n_turns) for r in got if r.conv_id < 3) == [(1, "ann", 3), (1, "bob", 3), (2, "", 3), (2, "unknown", 3)]
    own = next(r for r in got if r.conv_id == 2 and r.speaker is None)
    assert own.n_own == 1 and "user name=unknown" in own.rendered
    assert all(r.rendered.count("<|im_start|>") == r.n_turns for r in got) and not [r for r in got if r.conv_id == 4]
    for r in got:
        spans = [tuple(map(int, s.split(":"))) for s in r.mask.split(",")]
        assert len(spans) == r.n_own and sum(b - a for a, b in spans) == r.n_masked


def test_long_dialogues_are_ranked_without_turn_numbers(spark):
    rows = [(7, i // 3 if i % 5 else None, ("ann", "bob", "system")[i % 3], f"m{i % 4}") for i in range(100)] + [(8, 0, "ann", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = chat.perspectives(turns, piece_turns=16).collect()
    whole = {r.speaker: r.rendered for r in chat.perspectives(turns).where("conv_id = 7").collect()}
    for speaker in ("ann", "bob"):
        own = sorted((r for r in got if r.conv_id == 7 and r.speaker == speaker), key=lambda r: r.piece)
        assert [r.n_turns for r in own] == [16] * 6 + [4] and "\n".join(r.rendered for r in own) == whole[speaker]
    assert [r.n_turns for r in got if r.conv_id == 8] == [1]


def test_language_rejection_and_rare_languages(spark):
    rows = [(i, f"the quick brown fox {word(i)} jumps over lazy dogs again and again", "en") for i in range(300)] + [(1000 + i, "zwölf boxkämpfer jagen viktor quer über den großen sylter deich", "de") for i in range(4)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_types=3000)
    asked = spark.createDataFrame([(1, "the lazy dogs jump over the brown fox"), (2, "großen deich über sylter boxkämpfer"), (3, "щукжъ фывапр ячсмит"), (4, ""), (5, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in langid.predict(asked, model).collect()}
    assert model.langs == ["de", "en"] and got[1].lang_pred == "en" and got[2].lang_pred == "de"
    assert got[1].accepted and not got[3].accepted and got[4].lang_pred == got[5].lang_pred == "und" and got[5].cross_entropy is None


def test_language_scores_are_those_of_the_definition():
    samples = {"a": (["abab", "abba", "bab"], np.array([3, 1, 2])), "b": (["xyx", "yxxy"], np.array([1, 5]))}
    model = langid.estimate(["a", "b"], samples, order=3)
    for i in range(2):  # each context's probabilities of all symbols sum to one
        codes = sorted({int(c) for lang in samples for c in langid._layout(samples[lang][0])[0]})
        total = 0.0
        for c in codes:
            h = langid._hashes(np.array([c], dtype=np.uint64), 1)[1]
            row = langid._find(model.grams[i][0], h)[0]
            total += np.exp(model.probs[i][0][row]) if row >= 0 else np.exp(model.backoff[i][0][0] + model.floor)
        assert abs(total + np.exp(model.backoff[i][0][0] + model.floor) * (np.exp(-model.floor) - len(codes)) - 1) < 1e-3
    known = langid.Scored(model)
    from folioflow.llm.common import utf8
    import pyarrow as pa

    raw, at = utf8(pa.array(["abab bab xyx", "", "zz"]))
    first, again, plain = langid.score_texts(model, raw, at, known), langid.score_texts(model, raw, at, known), langid.score_texts(model, raw, at)
    assert np.allclose(first[0], again[0]) and np.allclose(first[0], plain[0], atol=1e-5) and (first[1] == plain[1]).all()


def test_quality_verdict(spark):
    good, bad = "all of these sentences look like the trusted ones we have here", "zqx jvk wqz xkq vzj qkx zvq jxw kqz vxj qzk wjx"
    frame = spark.createDataFrame([(i, f"{good} {word(i)}") for i in range(40)] + [(100 + i, f"{bad} {word(i)}") for i in range(40)], "doc_id bigint, text string")
    ratio = quality.fit(frame, frame.where("doc_id < 30").select("doc_id"))
    got = {r.doc_id: r for r in quality.rules(frame, ratio).collect()}
    assert all(got[i].kept for i in range(40)) and not any(got[100 + i].kept for i in range(40))
    again = quality.fit(frame, frame.where("doc_id < 30").select("doc_id").unionByName(frame.where("doc_id < 30").select("doc_id")))
    assert (again.weights == ratio.weights).all()


def test_large_groups_of_copies(spark):
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base)) for i in range(60)] + [(100 + i, " ".join([*base[:40], f"n{i}", *base[41:]])) for i in range(40)] + [(500, None), (None, "x"), (60, " ".join(base))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = neardup.near_duplicates(frame).collect()
    assert {r.component_id for r in got if r.doc_id is not None and r.doc_id < 500} == {0} and sum(r.kept for r in got) == 3
    found = {r.doc_id: r for r in substring.passages(frame).collect()}
    assert set(found) >= {*range(1, 61), *range(100, 140)} and found[5].n_matched == 80 and found[5].ref_doc_id == 0


def test_passages_that_many_own_in_pieces(spark):
    """Ten documents have a piece each of what two later ones share whole."""
    shared = [f"p{i}" for i in range(80)]
    rows = [(k, " ".join([*[f"d{k}_{i}" for i in range(9)], *shared[7 * k : 7 * k + 14]])) for k in range(10)] + [(1000, " ".join(["a", *shared])), (1001, " ".join(["b", "c", *shared]))]
    got = [(r.doc_id, r.ref_doc_id, r.n_matched) for r in substring.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert got == [(1001, 1000, 80)]


def in_pieces(shared, n, first=0, size=14):
    """Documents that have a piece each of a passage, every place of it in several of them."""
    return [(first + k, " ".join([*[f"d{first + k}_{i}" for i in range(9)], *shared[7 * k % 67 : 7 * k % 67 + size]])) for k in range(n)]


def test_passages_of_few_owners_between_owners_of_pieces(spark):
    """The last document's seeds have their least and their nearest owner in pieces; the one that shares the whole is between."""
    shared = [f"p{i}" for i in range(80)]
    fuzzy = [f"c{i}" if i % 11 == 10 else w for i, w in enumerate(shared)]
    rows = [*in_pieces(shared, 11), (500, " ".join(["a", *shared])), *in_pieces(shared, 11, 1000), (2000, " ".join(["b", "c", *shared])), (2001, " ".join(["e", *fuzzy]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for parts in (1, 5):
        got = sorted((r.doc_id, r.ref_doc_id, r.n_matched) for r in substring.passages(frame.repartition(parts)).collect())
        assert got == [(2000, 500, 80), (2001, 500, 73), (2001, 2000, 73)]


def test_passages_of_many_owners_between_owners_of_pieces(spark):
    """The same where all seeds have more owners than are linked in all pairs."""
    shared = [f"p{i}" for i in range(80)]
    rows = [*in_pieces(shared, 200), (500, " ".join(["a", *shared])), *in_pieces(shared, 200, 1000), (2000, " ".join(["b", "c", *shared])), (2001, " ".join(["e", *shared[10:60]]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for parts in (1, 5):
        got = {(r.doc_id, r.ref_doc_id, r.n_matched) for r in substring.passages(frame.repartition(parts)).collect()}
        assert got >= {(2000, 500, 80), (2001, 500, 50)} and {(d, r) for d, r, _ in got} <= {(2000, 500), (2001, 500), (2001, 2000)}


def test_passages_send_texts_once_a_document(spark, monkeypatch):
    """Sixteen documents share three passages, so each pair has three chains; the texts are not shuffled for each chain."""
    draw = random.Random(3)
    own = lambda: [f"{draw.getrandbits(48):x}" for _ in range(1500)]
    rows = [(k, " ".join(w for n in range(3) for w in [*own(), *[f"p{n}_{i}" for i in range(60)]])) for k in range(16)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    written = lambda: sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    want = [(d, k, 1560 * n + 1500, 60) for d in range(16) for k in range(d) for n in range(3)]
    rows_of = lambda: sorted((r.doc_id, r.ref_doc_id, r.start_word, r.n_matched) for r in substring.passages(frame).collect())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = written()
        assert rows_of() == want
        assert written() - before < 16 * sum(len(text) for _, text in rows)  # 33 with the texts for each chain; 11 now, most of them seeds
        monkeypatch.setattr(substring, "CELL", 1 << 17)  # several cells
        assert rows_of() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_passages_beyond_the_text_of_a_repeated_id(spark):
    """Two ids share a passage in their long texts only; their least texts, which are aligned, end before it."""
    shared = [f"p{i}" for i in range(80)]
    rows = [(k, " ".join([f"a{k}", *[f"x{k}_{i}" for i in range(50)]])) for k in (1, 2)] + [(k, " ".join([*[f"z{k}_{i}" for i in range(90)], *shared])) for k in (1, 2)]
    assert substring.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() == []


def test_growing_together_as_one_by_one(monkeypatch):
    monkeypatch.setattr(substring, "ALONE", 0)
    draw = random.Random(5)
    texts = []
    for k in range(40):
        base = [draw.choice("abcdefghijkl" if k % 2 else "ab") for _ in range(draw.choice((0, 1, 3, 20, 300)))]
        edits = [draw.choice(([w], [w], [w], [w], [w], [w], [w], [], ["z"], [w, "q"])) for w in base]
        texts += [" " + "  ".join(base) + draw.choice(("", "\n")), "\t".join(w for x in edits for w in x).upper()]
    number, first, end = substring._numbered(pa.array(texts))
    words = [t.lower().split() for t in texts]
    assert (end - first).tolist() == [len(w) for w in words]
    for step in (1, -1):
        jobs = [(k, k + 1, draw.randint(0, len(words[k])) - (step < 0), draw.randint(0, len(words[k + 1])) - (step < 0)) for k in range(0, 80, 2) for _ in range(20)]
        a, b, i, j = np.array(jobs).T
        got = substring._grow_all(number, (first[a], end[a]), i + first[a], (first[b], end[b]), j + first[b], step)
        got = list(zip(got[0].tolist(), (got[1] - first[a]).tolist(), (got[2] - first[b]).tolist()))
        assert got == [substring._grow(words[k], x, words[n], y, step) for k, n, x, y in jobs]


def test_id_filter(spark):
    frame = spark.range(5000).select((F.col("id") * 7).alias("doc_id"))
    bits = id_filter(frame, "doc_id")
    assert len(bits) == FILTER_BITS >> 3 and 4900 <= np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).sum() <= 5000
    asked = spark.range(35_000).select("id", filter_place("id").alias("p")).toArrow()
    inside = may_hold(bits, asked.column("p").combine_chunks()).to_numpy(zero_copy_only=False)
    ids = asked.column("id").to_numpy()
    assert inside[ids % 7 == 0].all() and inside[ids % 7 != 0].mean() < 0.01
