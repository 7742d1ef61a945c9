import itertools
import random
import re
import resource
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spark_explore.llm import byte_gru, html_lstm, pii_crf

SF = "/root/testdata/sf0.01"


def doubled(model):
    for field in model.FIELDS:
        setattr(model, field, getattr(model, field).astype(np.float64))
    return model


def check_gradients(model, gradients):
    grad = gradients()[1]
    for field in model.FIELDS:
        values = getattr(model, field)
        for at in np.argsort(-np.abs(grad[field]).ravel())[:3]:
            at = np.unravel_index(at, values.shape)
            old = values[at]
            losses = []
            for step in (1e-3, -1e-3):
                values[at] = old + step
                losses.append(gradients()[0])
            values[at] = old
            assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(grad[field][at], rel=1e-2, abs=1e-6)


def test_gru_gradients():
    rng = np.random.default_rng(0)
    model = doubled(byte_gru.new_model(["a", "b", "c"]))
    codes, labels = rng.integers(0, 256, (9, 5)), rng.integers(0, 3, 5)
    weight = rng.integers(0, 2, (9, 5)).astype(float)
    check_gradients(model, lambda: byte_gru.gradients(model, codes, labels, weight))


def test_gru_size():
    assert byte_gru.new_model(["a", "b"]).memory.shape == (2, 12, 12)


def test_language_of_held_out_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = byte_gru.fit(docs.where(~byte_gru.held_out()), per_language=80)
    got = {r["doc_id"]: r for r in byte_gru.identify(docs, model).collect()}
    rows = docs.where(byte_gru.held_out()).select("doc_id", "lang").collect()
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows]) > 0.95
    odd = [(1, None), (2, ""), (3, "12 34 !"), (4, rows and docs.first()["text"]), (4, docs.first()["text"]), (None, "und the")]
    extra = spark.createDataFrame([(i, t, "q", 0.1) for i, t in odd], "doc_id long, text string, lang_pred string, score double")
    found = byte_gru.identify(extra, model).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in found if r["doc_id"] in (1, 2, 3)} == {(k, "und", 0.0) for k in (1, 2, 3)}
    assert len({tuple(r) for r in found if r["doc_id"] == 4}) == 1 and len(found) == 6
    assert all(0 <= r["score"] <= 1 for r in found)
    unlabelled = extra.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert byte_gru.fit(unlabelled) is None
    assert {r["lang_pred"] for r in byte_gru.predict_all(unlabelled).collect()} == {"und"}
    assert byte_gru.predict_all(unlabelled.limit(0)).count() == 0


def test_rejects_what_is_no_language_and_keeps_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(1)
    odd = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(600)) for _ in range(20)]
    odd += ["これは日本語の文章です。私たちは毎日学校に行きます。" * 8, "Это русский текст, который никто не учил. " * 6, "", None, "12 34"]
    mixed = "\n".join(r["text"] for r in docs.where("length(text) > 500").groupBy("lang").agg(F.min("text").alias("text")).collect())
    more = [(10_000 + i, t, None, "s", 0) for i, t in enumerate([*odd, mixed])]
    kept = byte_gru.reject_unknown(docs.unionByName(spark.createDataFrame(more, docs.schema)))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {i for i in ids if i >= 10_000} == {10_000 + len(odd)}  # a text in several languages stays
    assert len(ids) - 1 >= 0.995 * docs.where(F.col("text").rlike("[a-z]")).count()


def test_windows_cover_whole_texts():
    data = "aé1" * 100
    raw = data.encode()
    letters = byte_gru.letter_bytes(raw)
    windows, inside, owner = byte_gru.cut(raw, np.array([0, len(raw), len(raw)]), letters)
    assert bytes(windows.ravel()[:len(raw)]) == raw and inside.sum() == 300 and set(owner) == {0}


def test_lstm_gradients():
    page = "<html><body><nav><a>x y</a></nav><article><h1>A b</h1><p>c d e.</p></article><footer>z</footer></body></html>"
    own = [html_lstm.blocks(page), html_lstm.blocks("<p>a<p>b")]
    model = doubled(html_lstm.new_model())
    rows = [[(html_lstm.path_slots(b.path), *html_lstm.described(b)[1:]) for b in o] for o in own]
    batch = html_lstm.batch_of(rows)
    labels = np.array([b.label == 1 for o in own for b in o], float)
    shared = html_lstm.batch_of([[html_lstm.described(b) for b in o] for o in own])
    assert np.allclose(html_lstm.forward(model, batch), html_lstm.forward(model, shared))
    check_gradients(model, lambda: html_lstm.gradients(model, batch, labels, np.ones(len(labels))))


def plain_article(page):
    """The article of the pages of the test tables, by cutting the string."""
    import html

    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    lines = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:h1|p|br)>", body)]
    return "\n".join(x for x in lines if x)


def test_main_text_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.orderBy("page_id").collect()
    model = html_lstm.train([r["html"] for r in rows[:100]], steps=250)
    got = html_lstm.main_texts(model, [r["html"] for r in rows[100:]])
    assert np.mean([g == plain_article(r["html"]) for g, r in zip(got, rows[100:])]) > 0.9
    odd = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<", "t"), (None, "u", "<script>x", "t"), (5, "u", "</p></b>", "t")],
                                "page_id long, url string, html string, text string")
    found = html_lstm.extract(odd, model).collect()
    assert [r["n_chars"] == len(r["text"]) for r in found] == [True] * 5
    assert {r["page_id"]: r["text"] for r in found if r["page_id"] in (1, 2, None, 5)} == {1: "", 2: "", None: "", 5: ""}
    assert html_lstm.extract_all(odd.limit(0)).count() == 0


def test_blocks():
    page = "<head><title>T</title></head><!-- <p>no --><body><p>a &amp; b\n c<b>d</b><p>e<br>f<script>g</script><ul><li>h<li>i</ul></body>"
    assert [b.text for b in html_lstm.blocks(page)] == ["T", "a & b cd", "e", "f", "h", "i"]
    assert [b.path[-1][0] for b in html_lstm.blocks(page)][-1] == "li"


@pytest.mark.parametrize("page,texts", [
    ('<p title="x > y">Hi</p>', ["Hi"]), ('see <a href="/a?x>1" rel=z>this</a>', ["see this"]), ("<p a = 'b>\"c' class=k>d", ["d"]),
    ("<p don't>a</p><p it's>b", ["a", "b"]), ('<p title="x>a<p>b', ['a', 'b']), ("a<!-- b > c", ["a"]), ("<p>a<!-- b", ["a"]), ("<p>a<!-->b", ["a"]),
    ("a < b > c", ["a < b > c"]), ("a <b", ["a <b"]), ("<p>a</p><b", ["a", "<b"]), ('<img alt="a > b"/>c', ["c"]), ("<p a==>x", ["x"]),
])
def test_tags_end_outside_quotes(page, texts):
    assert [b.text for b in html_lstm.blocks(page)] == texts


def test_homes_of_blocks():
    page = '<article><p>a<div class="comments"><main>b</main></div><div class="post share">c</div></article><nav>d</nav>e'
    assert [b.label for b in html_lstm.blocks(page)] == [1, 0, 1, 0, None]


def peak_of(work):
    """The result, seconds, and by how much the process has grown beyond its largest size before."""
    before, started = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    out = work()
    return out, time.time() - started, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) << 10


@pytest.mark.parametrize("page,many", [
    ("<p>w</p>" * 100_000, 100_000), ("<div>w" * 100_000, 100_000), ("<b>w" * 100_000, 1), ("<a " * 300_000, 1),
    ('<p t="' * 100_000 + ">", 1), ("<i><p>w" * 30_000, 30_000),
])
def test_long_pages_take_bounded_time_and_memory(page, many):
    model = html_lstm.new_model()
    pages = [page, *["<article><p>a<p>b</article>"] * 255]
    texts, spent, peak = peak_of(lambda: html_lstm.main_texts(model, pages))
    assert len(html_lstm.blocks(page)) in (many, 0) and len(set(texts[1:])) == 1
    assert spent < 60 and peak < 1 << 30, (spent, peak >> 20)


def test_long_texts_of_numbers_and_addresses():
    field = pii_crf.train_on(["word +1 (017) 555-7713 more 2024", "ask ab.cde@mail.example.com 3"] * 20)
    numbers = "a.bcdef@g.hi " + " ".join(str(10_000_000 + 7919 * i) for i in range(100_000))
    addresses = " ".join(f"local.part{i}@m.example.com" for i in range(40_000))
    for text, many in ((numbers, 1), (addresses, 40_000)):
        ((base,), _), spent, peak = peak_of(lambda: pii_crf.all_spans(field, [text]))
        assert len(base) == many and spent < 60 and peak < 1 << 30, (spent, peak >> 20)


def test_components_of_links():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (40, 30), (200, 150), (300, 299)):
        ends = rng.integers(0, n, (m, 2)) if m != 299 else np.array([[i, i + 1] for i in rng.permutation(299)])
        want = list(range(n))
        for _ in range(n):
            for a, b in ends:
                want[a] = want[b] = min(want[a], want[b])
        assert pii_crf._components(n, ends.reshape(-1, 2)).tolist() == want


PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def by_patterns(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 3 and 10 <= len(digits) <= 15
                    or kind == 2 and 14 <= len(digits) <= 19 and pii_crf.luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = [*"ab@@..+-() 1234567890", "é", "²", "4845168114407329", "+1 (017) 555-7713", "a@b.c", "10.0.0.1", "٣", "255.256.1.1", "0001.2.3.4"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 24)))
        assert pii_crf.base_spans(text) == by_patterns(text), repr(text)
    long = {"a" * 100_000: 0, "1" * 100_000: 0, "1." * 50_000: 12_500, "a" * 1000 + "@b.c": 1, "+" * 10_000: 0}
    assert {t: len(pii_crf.base_spans(t)) for t in long} == long


def test_messages_equal_enumeration_on_a_tree():
    rng = np.random.default_rng(0)
    field = pii_crf.Field(rng.normal(size=(pii_crf.FEATURES, 5)), rng.normal(size=(5, 5)), np.eye(5))
    features = rng.integers(0, 2, (4, pii_crf.FEATURES)).astype(np.float32)
    g = pii_crf.Graph([(0, i, i + 1) for i in range(4)], features, np.zeros(4, int), np.array([[0, 1], [1, 2]]), np.array([[1, 3]]))
    local = features @ field.unary
    want = np.zeros((4, 5))
    for labels in itertools.product(range(5), repeat=4):
        score = sum(local[i, l] for i, l in enumerate(labels)) + field.skip[labels[1], labels[3]]
        score += field.chain[labels[0], labels[1]] + field.chain[labels[1], labels[2]]
        for i, l in enumerate(labels):
            want[i, l] += np.exp(score)
    got = pii_crf.marginals(field, g)
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=2e-3)


def test_repetitions_get_the_label_and_clean_texts_none():
    numbers = ["+1 (%03d) 555-%04d" % (i, 1000 + 7 * i) for i in range(100, 160)]
    field = pii_crf.train_on([f"word other {n} more 2024 and 17 items." for n in numbers] + [f"ask ab.cd{i}@mail.example.com or so 3" for i in range(40)])
    text = "Call +1 (017) 555-7713 now, again 5557713 or 555-7713. mail loogm.24@m.example.com, loogm.24 there; in 2024 17 items"
    (base,), (spans,) = pii_crf.all_spans(field, [text])
    assert set(base) <= set(spans)
    added = {text[a:b]: pii_crf.KINDS[k] for a, k, b in set(spans) - set(base)}
    assert added.get("5557713") == "phone" and added.get("555-7713") == "phone" and added.get("loogm.24") == "email"
    assert not {"2024", "17"} & set(added)
    assert pii_crf.all_spans(field, ["call 5557713 in 2024", ""]) == ([[], []], [[], []])
    assert pii_crf.masked("x a@b.c y", [(2, 0, 7)]) == "x <EMAIL> y"


def test_messages_reach_the_end_of_a_long_chain():
    g = pii_crf.Graph([(0, i, i + 1) for i in range(26)], np.zeros((26, pii_crf.FEATURES), np.float32), np.array([4] + [0] * 25),
                      np.empty((0, 2), int), np.array([[i, i + 1] for i in range(25)]))
    field = pii_crf.Field(np.zeros((pii_crf.FEATURES, 5)), np.zeros((5, 5)), 6.0 * np.eye(5))
    p = pii_crf.marginals(field, g)
    assert (p[:, 4] >= pii_crf.SURE).all()
    # Along a chain the share of the own label falls to 1/5 by a constant factor.
    factor = (np.exp(6) - 1) / (np.exp(6) + 4)
    assert np.allclose(p[:, 4], 0.2 + 0.8 * factor ** np.arange(26), atol=2e-3)


@pytest.mark.parametrize("many", [50, 1000])
@pytest.mark.parametrize("number,bare,kind", [("+1 (017) 555-7713", "5557713", "phone"), ("+1 017 555 7713", "5557713", "phone"),
                                              ("loogm.24@m.example.com", "loogm.24", "email")])
def test_far_repetitions_get_the_label(spark, number, bare, kind, many):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text rlike '[0-9@]'").orderBy("doc_id").select("text").take(600)]
    field = pii_crf.train_on(texts)
    repeated = " ".join(f"again {bare} word in 2024" for _ in range(many))
    for text in (f"Call {number} now, {repeated}", f"{repeated} call {number} now", f"a.b@c.de, 10.0.0.1, {number} now, {repeated}"):
        (base,), (spans,) = pii_crf.all_spans(field, [text])
        added = [(text[a:b], pii_crf.KINDS[k]) for a, k, b in spans if (a, k, b) not in base]
        assert len(base) in (1, 3) and added == [(bare, kind)] * many


def test_find_and_mask_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a@b.cd"), (3, "a@b.cd"), (None, "10.0.0.1")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    got = pii_crf.find(docs, pii_crf.fit(docs)).collect()
    assert sorted((repr(r["doc_id"]), r["n_email"], r["n_ip"], r["spans"]) for r in got) == [
        ("1", 0, 0, ""), ("2", 0, 0, ""), ("3", 1, 0, "email:0:6"), ("3", 1, 0, "email:0:6"), ("None", 0, 1, "ip:0:8")]
    assert sorted(map(repr, (r["text"] for r in pii_crf.mask(docs).collect()))) == ["''", "'<EMAIL>'", "'<EMAIL>'", "'<IP>'", "None"]
    assert pii_crf.find_all(docs.limit(0)).count() == 0


def test_language_is_read_in_bounded_memory():
    """A worker's chunk of text, its windows and their states together."""
    import tracemalloc

    from spark_explore.llm.chunks import text_bytes, text_chunks

    model = byte_gru.new_model(["de", "en", None])
    batch = pa.RecordBatch.from_arrays([pa.array(["wörter " * 4000] * 220)], ["text"])
    tracemalloc.start()
    shares = [byte_gru.pooled(model, *text_bytes(c.column("text")))[1] for c in text_chunks([batch], "text", byte_gru.CHUNK)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, shares)) == 220 and np.allclose(np.concatenate(shares).sum(1), 1)
    assert peak < 80 << 20
