"""Each numbered query against a brute-force version over the whole smallest tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from tidemark.llm import queries as llm

DATA = "/root/testdata/sf0.001"
QUERIES = llm.queries()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")


def table(name, order):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet' ORDER BY {order}").fetchall()


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in table("documents", "doc_id")}


def run(spark, name):
    return QUERIES[name](spark, DATA).toPandas()


def test_queries_with_sql_agree_with_it(spark):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name, sql in llm.oracle_sql().items():
        df = QUERIES[name](spark, DATA)
        order = sorted(df.columns)
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        want = sorted(tuple(r[names.index(c)] for c in order) for r in result.fetchall())
        assert sorted(names) == order and sorted(map(tuple, df.select(*order).collect())) == want, name


def test_op1(spark):
    by = defaultdict(list)
    for conv, turn, role, text in table("conversations", "conv_id, turn"):
        by[conv].append((role or "", text or ""))
    by[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in run(spark, "op1_chat_format").itertuples()}
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        row = got[conv]
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss))
        assert row.formatted_chars > sum(len(t) for _, t in turns)


@pytest.mark.parametrize("name,label,modulus,rest,at", [("op2_quality", 1, 3, 1, 0.5), ("op8_toxicity", 2, 4, 2, 0.3)])
def test_classifiers(spark, texts, name, label, modulus, rest, at):
    got = run(spark, name)
    labels = {r[0]: r[label] for r in table("labels", "doc_id")}
    assert sorted(got.doc_id) == sorted(texts)
    for r in got.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= at)
    known = [(r.predicted, labels[r.doc_id]) for r in got.itertuples() if r.doc_id in labels]
    assert np.mean([a == b for a, b in known]) > 0.85


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_op3(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op3_pii").itertuples()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        want, row = base_spans(text), got[doc]
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert set(want) <= set(filter(None, row.spans.split(",")))


def test_op4(spark):
    import html

    got = {r.page_id: r for r in run(spark, "op4_main_text").itertuples()}
    pages = table("pages", "page_id")
    assert len(got) == len(pages)
    for page, url, source in pages:
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", re.search("<article>(.*?)</article>", source, re.S)[1])]
        want = "\n".join(b for b in blocks if b)
        assert (got[page].url, got[page].text, got[page].n_chars) == (url, want, len(want))


def test_op5(spark, texts):
    got = run(spark, "op5_decontaminate")
    words = lambda t: re.findall(r"\w+", t.lower())
    windows = lambda w: {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    items = {i: windows(words(t)) for i, t in table("benchmark", "item_id")}
    want = {(d, i) for d, t in texts.items() for own in [windows(words(t))] for i, w in items.items() if own & w}
    assert set(zip(got.doc_id, got.item_id, strict=True)) == want and want


def test_op6(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in run(spark, "op6_bpe").itertuples()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        row = got[doc]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op7(spark, texts):
    got = run(spark, "op7_shards")
    assert sorted(got.doc_id) == sorted(texts)
    size = {d: len(t.encode()) for d, t in texts.items()}
    total = Counter()
    for r in got.itertuples():
        assert r.bytes == size[r.doc_id]
        total[r.shard] += r.bytes
    assert all(r.shard_bytes == total[r.shard] <= llm.SHARD_BYTES for r in got.itertuples())


def shingle_sets(texts):
    words = {t: t.split() for t in set(texts.values())}
    return {t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for t, w in words.items()}


def test_op9(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op9_near_duplicates").itertuples()}
    sets, holders = shingle_sets(texts), defaultdict(list)
    for d, t in texts.items():
        holders[t].append(d)
    links, root = Counter(), {t: t for t in sets}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in combinations(sets, 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = defaultdict(list)
    for t, docs in holders.items():
        least[find(t)] += docs
    for d, t in texts.items():
        row = got[d]
        assert (row.class_id, row.n_links, row.n_copies) == (min(least[find(t)]), links[t], len(holders[t]))


def spark_hash(*values):
    """Spark's xxhash64 of strings and longs, chained from seed 42."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64(raw, seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def sketch(text):
    h = [spark_hash(w) for w in re.split(r"[\t\n\x0b\x0c\r ]+", text) if w]
    runs = [h[i : i + 5] for i in range(len(h) - 4)] if len(h) >= 5 else [h] if h else []
    every = {(spark_hash(*r) & (1 << 64) - 1) >> 1 for r in runs}
    return sorted(x for x in every if x < 1 << 61) or sorted(every)[:1]


def test_op10(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op10_fingerprints").itertuples()}
    ids = sorted(texts)
    assert sorted(got) == ids
    text_of = lambda s: "".join(f"{x:016x}" for x in s)

    def alike(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0

    sketches = {d: sketch(t) for d, t in texts.items()}
    for k, d in enumerate(ids):
        following, text = ids[(k + 1) % len(ids)], texts[d]
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[following][:half]
        row, new = got[d], sketch(edited)
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == text_of(sketches[d]) and row.edited_fingerprint == text_of(new)
        assert row.near_edited == pytest.approx(alike(sketches[d], new)) and row.near_next == pytest.approx(alike(sketches[d], sketches[following]))
