"""Plain Python beside the queries, over whole tables: templates and slots, the pipeline, and scores of held-out texts."""

from __future__ import annotations

import re
import sys
import zlib
from collections import defaultdict
from itertools import combinations, product
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, flat, quality, toxicity
from tidemark.llm.queries import op5_decontaminate
from tidemark.session import scratch_path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

DATA = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^\W_]+|[.!?\n]")
MARKS = set(".!?\n")


def template(text):
    """(raw token, kind) of every token but sentence marks; a literal word is its own kind."""
    out, tokens = [], TOKEN.findall(text or "")
    for i, t in enumerate(tokens):
        before = tokens[i - 1] if i else ""
        if t in MARKS:
            continue
        if t[0] in "0123456789":
            kind = "<num>"
        elif before[:1] in set("0123456789") and t.lower() in decontaminate.UNITS:
            kind = "<unit>"
        elif t[0].lower() != t[0]:
            kind = "<open>" if not i or before in MARKS else "<name>"
        else:
            kind = t.lower()
        out.append((t, kind))
    return out


def forms(token):
    """What a token may be read as."""
    raw, kind = token
    return ("<name>", raw.lower()) if kind == "<open>" else (kind,)


def shared_windows(docs, items):
    """(doc, item, place, at, size) of all pairs of windows that agree in some reading."""
    held = defaultdict(set)
    for item, tokens in items.items():
        size = min(8, len(tokens))
        for p in range(len(tokens) - size + 1) if size else ():
            window = tokens[p : p + size]
            for reading in product(*map(forms, window)) if size == 8 else [tuple(raw.lower() for raw, _ in window)]:
                held[size, reading].add((item, p))
    sizes = sorted({size for size, _ in held})
    known = {w for _, reading in held for w in reading}
    found = set()
    for doc, tokens in docs.items():
        options = [[f for f in forms(t) if f in known] for t in tokens]
        raws = [raw.lower() for raw, _ in tokens]
        for size in sizes:
            for at in range(len(tokens) - size + 1):
                readings = product(*options[at : at + size]) if size == 8 else [tuple(raws[at : at + size])]
                for reading in readings:
                    for item, place in held.get((size, reading), ()):
                        found.add((doc, item, place, at, size))
    return found


def contaminated(docs, items):
    alignments = defaultdict(set)
    for doc, item, place, at, size in shared_windows(docs, items):
        own = items[item]
        words = sum(kind in ("<open>",) or not kind.startswith("<") for _, kind in own)
        if size == 8 or words >= decontaminate.LEAST_WORDS or len(docs[doc]) == size:
            alignments[doc, item, at - place].add((place, size))
    places, changes = defaultdict(set), defaultdict(int)
    for (doc, item, shift), windows in alignments.items():
        pairs = {
            w: [(items[item][k][0].lower(), docs[doc][k + shift][0].lower()) for k in range(w[0], sum(w)) if items[item][k][1].startswith("<")] for w in windows
        }
        values = defaultdict(set)
        for old, new in (p for w in windows for p in pairs[w]):
            values[old].add(new)
        torn = {old for old, new in values.items() if len(new) > 1}
        counted = [w for w in windows if all(a == b for a, b in pairs[w]) or not torn & {a for a, _ in pairs[w]}]
        places[doc, item] |= {p for p, _ in counted}
        if counted:
            changes[doc, item] = max(changes[doc, item], len({a for w in counted for a, b in pairs[w] if a != b}))
    out = set()
    for (doc, item), found in places.items():
        n = len(items[item]) - min(8, len(items[item])) + 1
        if found and (len(found) >= decontaminate.LEAST_WINDOWS or len(found) / n >= decontaminate.LEAST_SHARE):
            out.add((doc, item, len(found), len(found) / n, changes[doc, item]))
    return out


def rows(table, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{DATA}/{table}.parquet' ORDER BY 1").fetchall()


def test_op5_equals_plain_templates_and_slots(spark):
    docs = {d: template(t) for d, t in rows("documents", "doc_id, text")}
    items = {i: template(t) for i, t in rows("benchmark", "item_id, text")}
    want = contaminated(docs, items)
    assert {tuple(r) for r in op5_decontaminate(spark, DATA).collect()} == want and want


def test_plain_templates_on_changed_questions(spark):
    """Items with other numbers, names, openings and torn slots, short ones among them."""
    texts = {
        1: "Tom has 5 apples and 12 kg of pears. Tom buys 3 more. How many apples does Tom have in all?", 2: "Anna reads 12 pages a day. Ben reads 15 pages a day. Carl reads 20.",
        3: "What is 2 and 3", 4: "42", 5: "12 red pens and 12 blue pens cost 7 euros in the shop of Mr Smith, says Ann. THE END! IS! NEAR!",
    }
    docs = {
        10: texts[1].replace("Tom", "Ben").replace("5", "9"), 11: texts[2].replace("Anna", "Zoe").replace("Carl", "Ann"), 12: "Please, what IS 2 and 3 to you", 13: "what is 2 and 4",
        14: "42", 15: "It was 42", 16: texts[5].replace("12 blue", "13 blue"), 17: "so " + texts[5].lower(), 18: texts[5].replace("12", "99"), 19: None, 20: "THE END! IS! NEAR! " * 9,
    }
    docs_df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    got = decontaminate.contaminated(docs_df, bench).select("doc_id", "item_id", "n_windows", "share", "n_changed")
    want = contaminated({d: template(t) for d, t in docs.items()}, {i: template(t) for i, t in texts.items()})
    assert {tuple(r) for r in got.collect()} == want
    assert {(d, i) for d, i, *_ in want} >= {(10, 1), (11, 2), (12, 3), (14, 4), (16, 5), (17, 5), (18, 5)}


def near_duplicates(docs):
    """One id of each class of texts that share 0.8 of their five-word shingles: the least."""
    def shingles(t):
        w = [x for x in re.split(r"[\t\n\x0b\x0c\r ]+", t or "") if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    plain = {d: t if shingles(t) else "" for d, t in docs.items()}
    sets = {t: shingles(t) for t in set(plain.values())}
    root = {t: t for t in sets}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in combinations(sets, 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    best = {}
    for d in sorted(plain):
        best.setdefault(find(plain[d]), d)
    return {d: docs[d] for d in best.values()}


def redact(text):
    from test_llm_queries import BASE, base_spans

    names, spans = list(BASE), []
    for s in base_spans(text or ""):
        kind, a, b = s.split(":")
        spans.append((int(a), int(b), names.index(kind)))
    out, at = "", 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += text[at:a] + f"<{names[kind].upper()}>"
        at = max(at, b)
    return out + (text or "")[at:]


def test_pipeline_equals_plain_python(spark):
    """All stages after the classifier, in plain Python from the ids that it keeps; the tables hold no identifiers beyond the fixed patterns."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, DATA).collect()}
    left = near_duplicates({d: t for d, t in rows("documents", "doc_id, text") if d in kept})
    items = {i: template(t) for i, t in rows("benchmark", "item_id, text")}
    bad = {d for d, *_ in contaminated({d: template(t) for d, t in left.items()}, items)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    about = {d: (lang, source) for d, lang, source in rows("documents", "doc_id, lang, source")}
    want = sorted((d, *about[d], library.encode(redact(t), add_special_tokens=False).ids) for d, t in left.items() if d not in bad)
    got = sorted((r.doc_id, r.lang, r.source, list(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want and bad and len(left) < len(kept) < 200
    assert scratch_path(spark, "x")


LABELS = {"quality": (3, 1, 0.5), "toxic": (4, 2, 0.3)}


@pytest.mark.parametrize("sf,label,least", [("0.001", "quality", 0.85), ("0.001", "toxic", 0.9), ("0.01", "quality", 0.95), ("0.01", "toxic", 0.9)])
def test_scores_of_held_out_texts(spark, sf, label, least):
    """Scores recomputed from the model's numbers one text at a time, and accuracy over held-out labels only."""
    data, (modulus, rest, at) = f"/root/testdata/sf{sf}", LABELS[label]
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    module = quality if label == "quality" else toxicity
    model = module.train(docs, labels, label, ~quality.held_out(modulus, rest))
    known = {r["doc_id"]: r[label] for r in labels.collect()}
    got = {r.doc_id: r for r in module.classify(docs, labels).collect()}
    right, n = 0, 0
    for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        held = zlib.crc32(str(r.doc_id).encode()) % modulus == rest
        assert got[r.doc_id].held_out == held
        if not held:
            continue
        bytes_, offsets = flat.buffers(quality.lower(pa.array([r.text])))
        if label == "quality":
            buckets, _, count = quality.features(bytes_, offsets)
            want = model[-1] + model[buckets].sum() / np.sqrt(max(1, count[0]))
        else:
            _, feature = toxicity.terms(bytes_, offsets)
            number = {f: k for k, f in enumerate(model["feature"].tolist())}
            chosen = [number[f] for f in feature.tolist() if f in number]
            v = model["v"][chosen].astype(float)
            want = model["bias"][0] + model["w"][chosen].sum() + sum(float(v[a] @ v[:a].sum(0)) for a in range(1, len(chosen)))
        assert got[r.doc_id].score == pytest.approx(float(quality.sigmoid(want)), abs=2e-3)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= at)
        if known.get(r.doc_id) is not None:
            n += 1
            right += got[r.doc_id].predicted == known[r.doc_id]
    assert n and right / n >= least
