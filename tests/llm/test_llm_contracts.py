"""Contracts and odd rows of single operators, and what the extraction of personal data recalls."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, html, jaccard, pii, sharding
from tidemark.llm.queries import op3_pii, op5_decontaminate, op7_shards

SF = "/root/testdata/sf0.001"


def test_loss_digests_follow_the_mask(spark):
    """With the mask of another role the digest changes with it: it is cut out of the formatted text."""
    hard = "<|im_end|> \\ </s>[INST] ok [/INST] \u00e9\U0001d4b3"
    turns = [(1, 0, "user", hard), (1, 1, "assistant", "a" + hard), (1, 2, "assistant", ""), (1, 3, "assistant", "b"), (2, 0, "user", "only")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    for role in ("assistant", "user"):
        got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df, learned=role)).collect()}
        for conv in (1, 2):
            want = "".join(t for c, _, r, t in turns if c == conv and r == role)
            assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(want), hashlib.sha256(want.encode()).hexdigest())


def test_repeated_rows_over_the_limit_are_shards_each(spark):
    docs = spark.createDataFrame([(1, "x" * 400)] * 3 + [(2, "y" * 500), (3, "z")], "doc_id long, text string")
    got = sharding.assign(docs, 40).collect()
    assert len(got) == 5
    big = [r for r in got if r.bytes > 40]
    assert len({r.shard for r in big}) == 4 and all(r.shard_bytes == r.bytes and r.shard.startswith("big-") for r in big)


def test_only_oversized_buckets_split(spark):
    """The shards of a whole table are the shortest prefixes that fit: the parent of each is over the limit."""
    limit = 20_000
    rows = sharding.assign(spark.read.parquet(f"{SF}/documents.parquet"), limit).collect()
    hashed = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = r["text"] or ""
        key = f"{r['doc_id']}:{hashlib.md5(text.encode()).hexdigest()}"
        hashed[r["doc_id"]] = (bin(int(hashlib.md5(key.encode()).hexdigest()[:15], 16))[2:].zfill(60), len(text.encode()))
    small = {d: (b, n) for d, (b, n) in hashed.items() if n <= limit}
    sums = {}
    for bits, n in small.values():
        for depth in range(61):
            sums[bits[:depth]] = sums.get(bits[:depth], 0) + n
    assert len(rows) == len(hashed)
    for r in rows:
        if r.doc_id in small:
            bits = small[r.doc_id][0]
            want = next(bits[:depth] for depth in range(61) if sums[bits[:depth]] <= limit)
            assert (r.shard, r.shard_bytes) == (want, sums[want])
    assert {r.doc_id for r in op7_shards(spark, SF).collect()} == set(hashed)


def test_texts_without_words_are_one_class(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " ", "\n\t", "\x0b\x0c\r", "word"])], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(docs).collect()}
    assert got == {**{i: (0, 0) for i in range(5)}, 5: (5, 0)}
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [0, 5]


def test_training_pages_are_chosen_by_id(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "<p>" + "x" * i) for i in range(50)] + [(None, None, "<p>n")] * 3, "page_id long, url string, html string")
    plan = pages.sparkSession  # the sample is bounded, whatever the number of rows that share an id
    assert plan is spark and html.train(pages, 10) is not None


def _filters(plan):
    return [line for line in plan.splitlines() if line.strip(" +-:|").startswith(("Filter", "Join"))]


def test_no_filter_tokenises(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    yes = lambda h: F.lit(True)
    shown = decontaminate._windows(decontaminate.with_template(docs.select("doc_id", "text")), [8], yes, yes, "doc_id")
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan
    assert not [line for line in _filters(plan) if "regexp_extract_all" in line]
    assert plan.count("regexp_extract_all") == 1
    assert bench.count()


def test_verbatim_items_are_found_and_tests_lose_nothing(spark):
    """With bitmaps that let all through the rows are the same."""
    want = {tuple(r) for r in op5_decontaminate(spark, SF).collect()}
    everything = decontaminate._bitmap
    try:
        decontaminate._bitmap = lambda hashes: lambda key: F.lit(True)
        assert {tuple(r) for r in op5_decontaminate(spark, SF).collect()} == want
    finally:
        decontaminate._bitmap = everything
    assert want


def corpus(rng):
    """Texts of 100 phrases with 12 identifiers each; four of twelve are written as no fixed pattern matches. And decoys beside them."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = digits(15)
        total = sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 == 0 else d for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    words = [a + b for a in ("bor", "lam", "tir", "gos", "pel", "nud", "vek", "zam", "hix", "jor") for b in ("an", "elle", "ig", "oth", "une", "ard", "esk", "ima", "op", "ux")]
    known = {
        "email": lambda: f"u{digits(6)}@mail.example.com",
        "ip": lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
    }
    hidden = {
        "email": lambda: f"u{digits(6)} [at] mail.example.com",
        "ip": lambda: ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8)),
        "card": lambda: (lambda c: "/".join(c[i : i + 4] for i in range(0, 16, 4)))(card()),
        "phone": lambda: f"{digits(3)} 555 {digits(4)}",
    }
    rows, planted = [], {}
    for p in range(100):
        kind, before, after = pii.KINDS[p % 4], f"{words[p]} {rng.choice(words)}", rng.choice(words)
        for k in range(12):
            found = (hidden if k % 3 == 2 else known)[kind]()
            # of the shape of a phone number, among words that no identifier stands among
            decoy = f"sold {digits(3)} 555 {digits(4)} {rng.choice(('apples', 'pears', 'nuts'))}" if k % 2 else f"part {digits(4)}/{digits(4)}/{digits(4)}/{digits(4)} shipped"
            text = f"please note {before} {found} {after} and we {decoy} to them"
            if k % 3 == 2:
                planted[len(rows)] = (kind, text.index(found), text.index(found) + len(found))
            rows.append((len(rows), text))
    rng.shuffle(rows)
    return rows, planted


def test_recall_and_precision_of_hidden_identifiers(spark):
    rows, planted = corpus(random.Random(11))
    got = pii.report(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "spans", "n_added").collect()
    added, right = 0, 0
    for r in got:
        spans = {tuple(s.split(":")) for s in r.spans.split(",") if s}
        if r.n_added:
            added += r.n_added
        if r.doc_id in planted:
            kind, a, b = planted[r.doc_id]
            right += (kind, str(a), str(b)) in spans
    print(f"recall {right / len(planted):.3f}, precision {right / max(added, 1):.3f} of {len(planted)} hidden, {added} added")
    assert right / len(planted) >= 0.9
    assert right / added >= 0.95


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_decoys_of_the_tables_stay_unmarked(spark, sf):
    assert op3_pii(spark, f"/root/testdata/{sf}").agg(F.sum("n_added")).first()[0] == 0


def test_patterns_hold_a_letter(spark):
    rows = [(i, f"12 , {4000000000000 + i:d}0000 ; 77") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, trusted = pii.score_patterns(pii._spans(docs))
    assert pii.report(docs).agg(F.sum("n_added")).first()[0] == 0
    assert trusted.where("trust < 1").count() == 0
