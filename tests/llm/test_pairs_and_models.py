"""Near-duplicates, search, chat logs and trained models against brute force and edge rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_rows import ROWS
from screenspark.llm import byte_cnn_lang, chat_events, toxicity
from screenspark.llm.components import components
from screenspark.llm.mih_search import nearest_neighbours
from screenspark.llm.pivot_dedup import embedding_components
from screenspark.llm.simhash_dedup import fingerprint, fingerprint_links, simhash_components


def union(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("leaves", [20_000, 8])
def test_fingerprint_links_equal_all_pairs(spark, leaves):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2)
    fps = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (12, 2))] + [0, 1, 2**64 - 1, 2**63]
    fps = sorted(set(fps))
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), leaves=leaves)
    place = {f: i for i, f in enumerate(signed)}
    got = [(place[r.u], place[r.v]) for r in edges.collect()]
    assert all((fps[i] ^ fps[j]).bit_count() <= 3 or union(len(fps), near)[i] == union(len(fps), near)[j] for i, j in got)
    assert union(len(fps), got) == union(len(fps), near)


def test_fingerprint_definition():
    import xxhash

    words = ["the", "cat", "sat", "on"]
    text = "The\x0bCAT  sat\ton"
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(2)]
    assert fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 2)
    assert fingerprint(None) == fingerprint(" \n") == 0
    assert fingerprint("É one") == xxhash.xxh64_intdigest("É one", 42)


def test_simhash_edge_rows(docs, no_docs):
    rows = simhash_components(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 7)} == {3}
    assert {r.fingerprint for r in rows if r.doc_id in (3, 4, 7)} == {"0" * 16}
    assert simhash_components(no_docs).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_components_of_many_blocks(spark, monkeypatch):
    from screenspark.llm import components as module

    monkeypatch.setattr(module, "BLOCK_EDGES", 25)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))]
    root = list(range(150))
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {i: root[i] for i in touched}


def test_pipeline_keeps_one_of_each_class(spark, docs):
    from corpus_pipeline import drop_near_duplicates

    kept = drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 5, 6]
    assert kept.filter("doc_id IS NULL").count() == 1


def vectors(spark, n=400, d=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[100:140] = x[:40] + rng.normal(size=(40, d)) * 0.05
    x[200:230] = x[0]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * d, 1), (n + 2, [float("nan")] * d, 1), (n + 3, [None] * d, 1), (n + 4, [float("inf")] + [1.0] * (d - 1), 1), (n + 20, [1.0], 1)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("block", [2048, 16])
def test_embedding_components_recall(spark, block):
    x, df = vectors(spark)
    rows = {r.vec_id: r for r in embedding_components(df, 0.95, block=block).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(1)
    got = np.array([rows[i].n_links for i in range(len(x))])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
    assert all(rows[i].n_links == 0 and rows[i].component_id == i and rows[i].kept for i in range(len(x), len(x) + 5))
    assert rows[0].n_links >= 30 and rows[229].component_id == 0 and not rows[229].kept
    assert embedding_components(df.limit(0)).count() == 0
    assert embedding_components(df.filter("vec_id >= 400")).count() == 6


def test_nearest_neighbours_recall_and_order(spark):
    x, df = vectors(spark)
    found = nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=10, shard_rows=100, query_rows=8).collect()
    hits = 0
    for q in range(0, 400, 20):
        rows = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 11)) and q not in {r.vec_id for r in rows}
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        score = x @ x[q]
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in rows)
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:10]
        hits += len(set(best) & {r.vec_id for r in rows})
    assert hits >= 0.9 * 200
    few = nearest_neighbours(df.filter("vec_id < 3"), F.col("vec_id") == 0, k=10).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert nearest_neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_embeddings_of_other_lengths_repeated_and_null_ids(spark):
    rng = np.random.default_rng(8)
    x = [float(v) for v in rng.normal(size=8)]
    y = [float(v) for v in rng.normal(size=8)]
    rows = [(1, x, "a"), (2, y, "b"), (2, y, "b"), (None, x, "c"), (4, [1.0, 2.0], "d"), (5, [1.0, 2.0], "e"), (6, [1.0, 2.1], "f"), (7, [2.0, -1.0], "g"), (8, [3.0], "h"), (None, [5.0, 1.0, 1.0], "i")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embedding_components(df, block=2).collect())
    assert got == [((False, 1), 1, 1, True), ((False, 2), 1, 2, True), ((False, 2), 1, 2, True), ((False, 4), 2, 4, True), ((False, 5), 2, 4, False), ((False, 6), 2, 4, False), ((False, 7), 0, 7, True), ((False, 8), 0, 8, True), ((True, 0), 0, None, False), ((True, 0), 1, 1, False)]


def test_pairs_at_the_threshold_are_verified_in_double_precision(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(60, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(60, 32))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = 0.95 + np.linspace(-1e-3, 1e-3, 60)
    other = cos[:, None] * base + np.sqrt(1 - cos**2)[:, None] * side
    x = np.concatenate([base, other])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links = {r.vec_id: r.n_links for r in embedding_components(df, pivots=8, prefix=8).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [links[i] for i in range(120)] == ((u @ u.T >= 0.95).sum(1) - 1).tolist()


def test_neighbours_of_ties_repeats_null_ids_lengths_and_clashes(spark):
    rows = [(0, [1.0, 0.0], 9), (0, [1.0, 0.0], 9), (1, [0.5, 0.0], 9), (2, [0.5, 0.0], 9), (None, [0.5, 0.0], 9), (20, [2.0], 9), (21, [3.0], 9), (22, None, 9), (40, [1.0, 2.0, 3.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int")
    found = nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=3).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found if r.query_id == 0)
    assert got == [(0, 1, 0, 1.0), (0, 1, 0, 1.0), (0, 2, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (0, 3, 2, 0.5)]
    assert [(r["rank"], r.vec_id, r.score) for r in found if r.query_id == 20] == [(1, 21, 6.0)]
    assert not [r for r in found if r.query_id == 40] and nearest_neighbours(df.filter("vec_id = 22"), F.lit(True)).count() == 0


def test_probes_reach_every_code_within_the_radius():
    from screenspark.llm import mih_search

    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (4000, 64), dtype=np.uint8)
    index, query = mih_search.SubstringIndex(codes), codes[0].copy()
    for i in range(1, 200):  # near codes of 40 to 127 bits apart
        flip = np.zeros(512, np.uint8)
        flip[rng.choice(512, int(rng.integers(40, 128)), replace=False)] = 1
        codes[i] = query ^ np.packbits(flip)
    index = mih_search.SubstringIndex(codes)
    found = np.concatenate([index.probe(query, mih_search.SHELLS[e]) for e in range(4)])
    apart = index.apart(query, np.arange(4000))
    assert set(np.flatnonzero(apart < 32 * 4).tolist()) <= set(found.tolist()) and len(set(found.tolist())) < 0.45 * 4000


def fold(events):
    """Plain replay of one conversation's log."""
    messages = []
    for seq, target, kind, role, text in sorted(events):
        at = [m for m in messages if m["n"] == target]
        if kind == "message":
            messages.append({"n": target, "role": role, "text": text})
        elif kind == "regenerate":
            messages = [m for m in messages if m["n"] <= target]
            for m in at:
                m["text"] = ""
        elif at:
            at[-1]["text"] = text if kind == "edit" else at[-1]["text"] + text
    return [(m["role"], m["text"]) for m in sorted(messages, key=lambda m: m["n"])]


@pytest.mark.parametrize("part", [1024, 3])
def test_event_logs_fold_like_a_replay(spark, part):
    log = {
        1: [(0, 0, "message", "user", "hi"), (1, 1, "message", "assistant", "a"), (2, 1, "delta", None, "b"), (3, 3, "message", "user", "no"), (4, 1, "regenerate", None, None), (5, 1, "delta", None, "new"), (6, 6, "message", "user", "<|end|>[INST]\\"), (7, 0, "edit", None, "hello")],
        2: [(i, i, "message", "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(10)] + [(10, 5, "regenerate", None, None), (11, 5, "delta", None, "again"), (12, 12, "message", "user", "last"), (13, 99, "delta", None, "lost")],
    }
    rows = [(c, s, t, k, r, x) for c, e in log.items() for s, t, k, r, x in e]
    df = spark.createDataFrame(rows, "conv_id long, seq long, target long, kind string, role string, text string")
    out = chat_events.format_conversations(df.repartition(5), part_messages=part).collect()
    for c in log:
        whole = "".join(r.formatted for r in sorted((r for r in out if r.conv_id == c), key=lambda r: (r.part, r.row)))
        assert chat_events.parse(whole) == fold(log[c])


def test_escape_is_reversible():
    for text in ["</s>[INST] ok [/INST]", "<\\|end|>", "<\\\\s>", "\\<s>", "[[INST]", "<|turn|><|text|>", "plain", ""]:
        safe = chat_events.escape(text)
        assert chat_events.unescape(safe) == text and not any(c in safe for c in chat_events.CONTROL)


def test_chat_digests(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "</s> b"), (1, 1, "assistant", "</s> b"), (2, None, None, None), (None, 3, "assistant", "ünï")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = {r.conv_id: r for r in chat_events.conversation_digests(chat_events.written_conversations(df)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\n</s> b\nassistant\n</s> b\n").hexdigest()
    assert got[1].loss_chars == 12 and got[1].loss_sha256 == hashlib.sha256(b"</s> b</s> b").hexdigest()
    assert got[2].n_turns == 1 and got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[None].loss_chars == 3
    assert chat_events.conversation_digests(chat_events.written_conversations(df.limit(0))).count() == 0


def test_very_long_texts_and_conversations(spark):
    long = "</s>[INST] words " * 30_000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", long if i == 1 else f"m{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    (got,) = chat_events.conversation_digests(chat_events.written_conversations(df)).collect()
    said = "".join(r[3] for r in rows if r[2] == "assistant")
    assert got.n_turns == 3000 and got.loss_chars == len(said) and got.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in rows).encode()).hexdigest()


WORDS = {"en": ["the", "and", "with", "this"], "de": ["der", "und", "mit", "über"]}


def corpus(spark, n=240):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(n):
        lang = ["en", "de"][i % 2]
        words = rng.choice(WORDS[lang], 60).tolist()
        toxic = int(i % 3 == 0)
        if toxic:
            words[int(rng.integers(60))] = ["scum", "scumbag"][i % 2]
        rows.append((i, " ".join(words), lang))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_language_held_out_accuracy_and_edge_rows(spark, docs, no_docs):
    train, _ = corpus(spark)
    model = byte_cnn_lang.train_language_model(train, epochs=3)
    rows = byte_cnn_lang.predict_language(train, model).filter("held_out").collect()
    assert rows and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.95
    edge = byte_cnn_lang.predict_language(docs, model).collect()
    assert len(edge) == len(ROWS) and all(0 <= r.lang_score <= 1 for r in edge)
    assert {r.lang_pred for r in edge if r.doc_id in (3, 4, 7)} == {"und"}
    assert byte_cnn_lang.predict_language(no_docs, byte_cnn_lang.train_language_model(no_docs)).count() == 0


def test_toxicity_held_out_accuracy_and_edge_rows(spark, docs, no_docs):
    train, labels = corpus(spark)
    net = toxicity.train_toxicity(train, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score_toxicity(train, net).filter("held_out").collect()
    assert rows and np.mean([r.tox_pred == truth[r.doc_id] for r in rows]) >= 0.9
    assert all(0 <= r.tox_score <= 1 and r.tox_pred == int(r.tox_score >= 0.5) for r in rows)
    assert toxicity.score_toxicity(docs, net).count() == len(ROWS)
    assert toxicity.score_toxicity(no_docs, net).count() == 0
    assert toxicity.train_toxicity(no_docs, labels) is None and toxicity.score_toxicity(docs, None).count() == len(ROWS)


def test_gradients_of_the_gated_net():
    rng = np.random.default_rng(2)
    net = toxicity.GatedNet()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(5, 2 * toxicity.DIM))
    index = np.array([[0, 1, 2, 5], [3, 4, 0, 1]])
    table = lambda: {s: np.concatenate([x @ net.p[f"in_{s}"] + net.p[f"bias_{s}"], np.zeros((1, 3 * toxicity.HIDDEN))]) for s in "fb"}
    _, saved = net.forward(table(), index, keep=True)
    grads, gates = net.backward(saved, np.ones(2))
    for name in ("rec_f", "rec_b", "att", "att_out", "out"):
        at = tuple(rng.integers(s) for s in net.p[name].shape)
        base = net.p[name][at]
        net.p[name][at] = base + 1e-3
        up = net.forward(table(), index).sum()
        net.p[name][at] = base - 1e-3
        down = net.forward(table(), index).sum()
        net.p[name][at] = base
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3, name
    assert gates["f"].shape == (4, 2, 3 * toxicity.HIDDEN)
