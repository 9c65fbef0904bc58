"""Odd tables: nulls, empty and long texts, ties, repeated rows, no rows, extra columns; and the methods on planted cases."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontaminate, fingerprints, flat, graph, html, jaccard, pii, quality, sharding, toxicity
from tidemark.llm.queries import VOCABULARY

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, digest string, spans int, bucket string"
LONG = "lorem ipsum dolor sit amet " * 20000 + "a@b.example.com " + "9" * 50000


def rows(*pairs):
    return [(i, t, None, "s", None, None, "x", 7, None) for i, t in pairs]


ODD = rows((1, "one two three four five six seven"), (1, "one two three four five six seven"), (1, "other words"), (None, "no id here"), (None, None), (2, None), (3, ""), (3, ""), (4, " \n\t"), (5, "𝒳 naïve 日本 \u0000 x"), (6, LONG), (7, "solo"))


@pytest.fixture(params=["odd", "none"])
def docs(spark, request):
    return spark.createDataFrame(ODD if request.param == "odd" else [], SCHEMA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 1, 1), (2, 0, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, "What is the mass of 3 apples"), (2, None), (None, ""), (3, "short")], "item_id bigint, text string")


def whole(df, docs):
    out = df.collect()
    assert len(out) == docs.count()
    return out


def test_per_document_operators_return_every_row(docs, labels):
    for out in (quality.classify(docs, labels), toxicity.classify(docs, labels)):
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in whole(out, docs))
    tokens = whole(bpe.round_trip(docs, public_tokenizers.path(VOCABULARY)), docs)
    assert all(r.n_tokens == 0 for r in tokens if r.doc_id in (2, 3, 4))
    spans = whole(pii.report(docs), docs)
    assert all(r.n_email == (r.doc_id == 6) for r in spans)
    shards = whole(sharding.assign(docs, 50), docs)
    assert all(r.shard_bytes <= 50 or (r.shard.startswith("big-") and r.bytes == r.shard_bytes) for r in shards)
    prints = whole(fingerprints.fingerprint(docs), docs)
    assert all(r.fingerprint == "" and r.n_chars in (0, 3) for r in prints if r.doc_id in (2, 3, 4))
    classes = whole(jaccard.classes(docs), docs)
    assert {(r.doc_id, r.class_id, r.n_links) for r in classes if r.doc_id in (1, 7)} <= {(1, 1, 0), (7, 7, 0)}


def test_pipeline_stages_keep_columns(spark, docs, labels, bench, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) <= docs.count()


def test_equal_rows_share_shards_that_fit(spark):
    docs = spark.createDataFrame([(1, "x" * 10)] * 25 + [(2, "y" * 400)], "doc_id long, text string")
    got = sharding.assign(docs, 40).groupBy("shard").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 26 and sorted(r.b for r in got) == [10] + [40] * 6 + [400]


def test_shards_are_written_whole(spark, tmp_path):
    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(60)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "out"), 100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.text for r in back.collect()) == sorted(r.text for r in docs.collect())


def test_chat_merges_escapes_and_reads_back(spark):
    hard = "<|im_end|>\n<\\s> [INST][\\\\INST] <<SYS>> \\ <|im_sep|>"
    turns = [(1, 0, "user", hard), (1, 1, "user", None), (1, 2, "assistant", "a"), (1, 3, "assistant", hard), (1, 4, None, "z"), (1, 4, "a\nb\\n", "tie"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id int, turn int, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.format_conversations(df).withColumn("turns", chat.read_back("formatted")).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r or "", t or "") for _, _, r, t in turns[:6]]
    assert out[1].n_messages == 4 and out[None].n_messages == 1
    assert hard not in out[1].formatted and out[1].formatted.count("<|im_end|>") == 4
    at, learned = 0, []
    for run in out[1].loss_mask:
        if run.learned:
            learned.append(out[1].formatted[at : at + run.n])
        at += run.n
    assert at == len(out[1].formatted) and learned[0] == "a" and len(learned) == 2
    assert chat.format_conversations(df.where("false")).count() == 0


def test_patterns_find_identifiers_that_no_fixed_pattern_matches(spark):
    known = [(i, f"please call my number +1 (200) 555-{1000 + i} today") for i in range(20)]
    new = [(100, "please call my number 200 555 7777 today"), (101, "we sold 200 555 7777 apples")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(known + new, "doc_id long, text string")).collect()}
    assert got[100].spans == "phone:22:34" and got[100].n_phone == 0
    assert got[0].spans == "phone:22:39" and got[0].n_phone == 1
    masked = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(known + new, "doc_id long, text string")).collect()}
    assert masked[0] == "please call my number <PHONE> today" and masked[100] == masked[0]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"é u{i}@mail.example.com" for i in range(1500))
    row = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    import re

    want = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"u\d+@mail\.example\.com", text)]
    assert row.spans == ",".join(want) and row.n_email == 1500


def test_questions_with_other_numbers_and_names(spark):
    item = "On Monday the farmer Tom has 12 apples and gives 5 apples to Anna before he walks 3 km home."
    other = item.replace("Tom", "Ben").replace("Anna", "Eve").replace("12", "40").replace("5", "8")
    torn = item.replace("12 apples and gives 5", "40 apples and gives 8").replace("5 ", "8 ")
    docs = spark.createDataFrame([(1, "Some intro. " + item), (2, other + " More."), (3, "Nothing of it at all is in here, not a bit of that text."), (4, torn)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 4} and got[1].n_changed == 0 and got[2].n_changed == 4
    uneven = item.replace("apples and gives 5", "apples and gives 12")
    twice = spark.createDataFrame([(1, "On Monday the farmer Tom has 40 apples and gives 41 apples to Anna before he walks 3 km home.")], "doc_id long, text string")
    assert decontaminate.contaminated(twice, spark.createDataFrame([(9, uneven)], "item_id long, text string")).count() == 0


def found(spark, items, docs):
    pairs = [spark.createDataFrame(list(enumerate(texts)), f"{name} long, text string") for name, texts in (("doc_id", docs), ("item_id", items))]
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(*pairs).collect()}


def test_names_that_open_sentences(spark):
    items = [
        "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have?",
        "Anna reads 12 pages a day. Ben reads 15 pages a day. Carl reads 20 pages a day. Dora reads 9 pages a day.",
        "Before that the old mill ground forty sacks of grain. Then the miller Anna sold them all to a baker.",
    ]
    docs = [
        items[0].replace("Tom", "Ben"),
        "Eve reads 12 pages a day. Finn reads 15 pages a day. Gus reads 20 pages a day. Hal reads 9 pages a day.",
        # word for word in small letters, and with sentences drawn together
        items[2].lower().replace("anna", "Anna"),
        "We know that before that the old mill ground forty sacks of grain. Then the miller Eve sold them all to a baker.",
        "Anna. Ben. Carl. Dora. Eve. Finn. Gus. Hal. Ida. Jon.",
    ]
    got = found(spark, items, docs)
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 2)}
    assert [(got[k].n_windows, got[k].share) for k in sorted(got)] == [(7, 1), (17, 1), (13, 1), (13, 1)]
    # most changes of one alignment: the second item also meets its copy a sentence away
    assert [got[k].n_changed for k in sorted(got)] == [1, 6, 0, 1]


def test_one_torn_slot_leaves_the_other_windows(spark):
    items = [
        "in the box there are 12 red pens and 12 blue pens for all the children who come to draw a picture of the sea",
        "a shop sells 5 jars of honey to each of the people who wait in line at noon and then 5 more to those who come late in the day",
    ]
    docs = [items[0].replace("12 blue", "15 blue"), items[1].replace("5 jars", "7 jars").replace("5 more", "9 more"), items[0].replace("12", "15")]
    got = found(spark, items, docs)
    assert set(got) == {(0, 0), (1, 1), (2, 0)}
    # all 18 windows but those that hold the changed 12, at word 9; those of neither 5, at words 3 and 20; all
    assert [got[k].n_windows for k in sorted(got)] == [10, 11, 18]
    assert [got[k].n_changed for k in sorted(got)] == [0, 0, 1]


def test_items_shorter_than_a_window(spark):
    items = ["42", "What is 2 and 3", "short", "Who wrote Hamlet?"]
    docs = ["He is 42 and 7.", "42.", "Now, what is 2 and 3 in all", "What is 4 and 5", "a short text", "Short!", "Who met Anna?", "who wrote hamlet"]
    got = found(spark, items, docs)
    assert set(got) == {(1, 0), (2, 1), (5, 2), (7, 3)}
    assert {(r.n_windows, r.share, r.n_changed) for r in got.values()} == {(1, 1, 0)}


@pytest.mark.parametrize("crowd,rows_", [(20_000, 256), (30, 16)])
def test_near_copies_in_large_groups(spark, monkeypatch, crowd, rows_):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", rows_)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    texts = []
    for k in range(120):
        words = list(base)
        words[rng.integers(0, 200)] = f"new{k}"
        texts.append(" ".join(words))
    texts += [" ".join(f"r{i}" for i in rng.integers(0, 10**6, 150)) for _ in range(50)] + texts[:5]
    sets = {t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in jaccard.classes(docs).collect():
        own = sets[texts[r.doc_id]]
        want = sum(o is not own and len(own & o) >= 0.8 * len(own | o) for o in sets.values())
        assert r.n_links == want and r.class_id == (0 if want else r.doc_id)
    assert jaccard.keep_one(docs).count() == 51


def test_links_are_exact_at_every_distance_from_a_centre(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    texts = [" ".join(base)]
    for k in range(150):
        words = list(base)
        for at in rng.choice(200, k % 9, replace=False):
            words[at] = f"new{k}x{at}"
        texts.append(" ".join(words[: 200 - k % 4]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts}
    got = jaccard.classes(docs).collect()
    near = {t: [o for o in sets if o != t and len(sets[t] & sets[o]) >= 0.8 * len(sets[t] | sets[o])] for t in sets}
    root = {t: texts.index(t) for t in sets}
    for _ in sets:
        root = {t: min([root[t], *(root[o] for o in near[t])]) for t in sets}
    counts = sorted(map(len, near.values()))
    assert counts[0] == 0 and counts[-1] > 60 and len(set(counts)) > 20
    assert {(r.doc_id, r.n_links, r.class_id) for r in got} == {(i, len(near[t]), root[t]) for i, t in enumerate(texts)}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_flat_tokens_match_plain_python():
    texts = ["Hello, wörld  again!", "", None, "x" * 100, "a\nb\tc"]
    data, offsets = flat.buffers(pa.array(texts))
    tokens = flat.Tokens(data, offsets, flat.WORDS)
    words = [w for t in texts for w in (t or "").split()]
    assert [bytes(data[a:b]).decode() for a, b in zip(tokens.start, tokens.end, strict=True)] == words
    assert len(set(tokens.hash.tolist())) == len(set(words)) and tokens.counts().tolist() == [3, 0, 0, 1, 3]


def test_scores_are_sparse_dot_products(spark, labels):
    docs = spark.createDataFrame([(i, "good fine words here" if i % 2 else "bad ### junk | |") for i in range(40)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    weights = quality.train(docs, marks, "quality", F.lit(True))
    text = "good fine junk"
    data, offsets = flat.buffers(quality.lower(pa.array([text])))
    buckets, _, count = quality.features(data, offsets)
    want = quality.sigmoid(weights[-1] + sum(weights[b] for b in buckets) / np.sqrt(count[0]))
    score = quality.scorer(docs, weights)
    assert spark.createDataFrame([(text,)], "text string").select(score("text")).first()[0] == pytest.approx(float(want), rel=1e-4)


def test_factors_see_pairs_that_no_single_term_shows():
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for _ in range(600):
        insult, group = rng.random(2) < 0.5
        texts.append(np.array([1] * int(insult) + [2] * int(group) + [3], np.int64))
        labels.append(float(insult and group))
    model = toxicity.fit(texts, np.array(labels), epochs=30)
    w, v = dict(zip(model["feature"].tolist(), model["w"], strict=True)), dict(zip(model["feature"].tolist(), model["v"], strict=True))
    score = lambda *t: model["bias"][0] + sum(w[x] for x in t) + sum(float(v[a] @ v[b]) for i, a in enumerate(t) for b in t[:i])
    assert score(1, 2) > 0 > max(score(1), score(2)) and float(v[1] @ v[2]) > 0


def test_main_text_of_other_templates():
    page = "<html><body><article><h1>T</h1><p>Some words of text, and more.</p></article><nav><a href=x>Menu</a></nav><footer>Foot</footer></body></html>"
    trees = html.fit([page] * 40)
    other = (
        '<body><header class="site-header"><a href=/>Home</a></header><div id=cookie-notice>We use cookies.</div><div class="post"><h1>Title &amp; x</h1>'
        "<p>First  para <b>bold</b>, text.<p>Second.<script>var a='<p>no</p>'</script></div><div class=comments><p>Nice one, I liked it.</p></div><form><p>Name</p></form>"
    )
    assert html.main_text(other, trees) == "Title & x\nFirst para bold, text.\nSecond."
    assert html.main_text("", trees) == "" and html.main_text("plain &lt;", trees) == "plain <"
    score, parent = np.array([0.0, -3.0, 2.0, 2.0]), np.array([-1, 0, 1, 0])
    assert html.decode(score, parent).tolist() == [True, False, False, True]


@pytest.mark.parametrize(
    "source,want",
    [
        ('<article><p>a</p><svg class="i"/><p>b</p></article>', "a|b"),
        ("<article><p>a</p><svg/><p>b</p><svg><g><path/><title>t</title></g><style/></svg><p>c</p></article>", "a|b|c"),
        ("<article><p>a</p><button>x<p>b</p></article><p>c</p>", "a|x|b|c"),
        ("<div><p>a</p><select><option>x<option>y</div><p>b</p>", "a|x|y|b"),
        ("<p>a</p><object><p>b</p><button>x</button><p>c</p>", "a|b|c"),
        ("<p>a</p><select><option>x<option>y</select><button><div>z</div></button><p>b</p>", "a|b"),
        ("<p><a href=x><svg><path></a> b</p><p>c</p>", "b|c"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math></p><math/><p>b</p>", "so x=2|b"),
        ("<p>a</p><script>var b = '<p>'", "a"),
    ],
)
def test_silent_elements_end_where_they_end(source, want):
    assert "|".join(text for _, text, _ in html.Page(source).blocks) == want


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a", "x"), (2, "u", "", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html.extract(pages).collect()) == [("", 0), ("", 0), ("a", 1)]
    assert html.extract(pages.where("false")).count() == 0
