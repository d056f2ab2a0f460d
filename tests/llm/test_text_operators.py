"""Operators on documents: nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edge_rows import ROWS
from screenspark.llm import packing, piece_nbest, seekable_tokens
from screenspark.llm.encoding import encoder
from screenspark.llm.piece_nbest import lattice, segment_texts
from screenspark.llm.token_counts import counter, public_path, token_counts

os.environ["TOKENIZERS_PARALLELISM"] = "false"
TEXT = st.lists(st.sampled_from(list("abet sIL'1.!\n\t\r\x00") + ["é", "ß", "İ", "é", "日", " ", "　", "  ", "<|endoftext|>", "'s", "aaaa"]), max_size=20).map("".join)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(public_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_counts_and_ids_equal_the_library(library, texts):
    array = pa.array(texts, pa.string())
    assert counter("byte_bpe_50k.json").count(array).tolist() == [len(library["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids) for t in texts]
    flat, stops = encoder("word_bpe_49k.json").encode(array, 2)
    assert [x.tolist() for x in np.split(flat, stops)[:-1]] == [library["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_token_counts_edge_rows(docs, no_docs, library):
    rows = token_counts(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    want = sorted(repr((r.doc_id, len((r.text or "").encode()), len(library["byte_bpe_50k.json"].encode(r.text or "", add_special_tokens=False).ids))) for r in texts)
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_tokens)) for r in rows) == want
    assert token_counts(no_docs).count() == 0


def test_leftmost_merges_where_all_at_once_is_not_exact(tmp_path):
    """A vocabulary in which the product of a pair starts a merge of a lower rank."""
    import json

    from tokenizers import Tokenizer

    from screenspark.llm.token_counts import TokenCounter, byte_letters

    spec = json.load(open(public_path("byte_bpe_50k.json")))
    merges = [["ab", "a"], ["a", "b"], ["aba", "b"]]
    letters = byte_letters()
    spec["model"]["merges"] = merges
    spec["model"]["vocab"] = {t: i for i, t in enumerate([*letters, "ab", "aba", "abab"])}
    spec["added_tokens"] = []
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    words = ["abab", "ababab", "aab", "ba", "abababab"]
    tokenizer = Tokenizer.from_file(str(path))
    assert TokenCounter(str(path)).count(pa.array(words)).tolist() == [len(tokenizer.encode(w).ids) for w in words]


def brute_windows(lengths, window):
    rooms = []
    for n in lengths:
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(window - n)
    return sorted(rooms)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_decreasing(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    number, offset = packing.best_fit_decreasing(lengths, 32)
    used = {}
    for k, o, n in zip(number.tolist(), offset.tolist(), lengths.tolist(), strict=True):
        assert used.get(k, 0) == o
        used[k] = o + n
    assert sorted(32 - x for x in used.values()) == brute_windows(lengths.tolist(), 32)


def test_packing_edge_rows(docs, no_docs):
    rows = packing.pack_documents(docs, window=64, with_ids=True, group_pieces=100).collect()
    windows, documents = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert windows.get(r.sequence_id, 0) == r.offset and len(r.ids) == r.length
        windows[r.sequence_id] = r.offset + r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        documents.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert max(windows.values()) <= 64
    assert sum(n for x in documents.values() for _, n in x) == sum(len(encoder("word_bpe_49k.json").encode(pa.array([t[1]], pa.string()), 2)[0]) for t in ROWS)
    assert (3, 1) in documents and (4, 1) in documents
    assert packing.pack_documents(no_docs).count() == 0


def test_token_files_round_trip(spark, docs, no_docs):
    manifest = seekable_tokens.write_token_files(docs.repartition(4))
    rows = seekable_tokens.read_token_files(manifest).collect()
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    want, start = [], 0
    for known, i, t in texts:
        ids = encoder("word_bpe_49k.json").encode(pa.array([t]), 2)[0]
        want.append((i if known else None, start, ids.tolist()))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, list(r.ids)) for r in rows), key=lambda x: x[1]) == want
    some = seekable_tokens.read_token_files(manifest, wanted=[2, 6]).collect()
    assert sorted(r.doc_id for r in some) == [2, 2, 6]
    assert seekable_tokens.read_token_files(seekable_tokens.write_token_files(no_docs)).count() == 0


def test_token_file_checksum(tmp_path):
    path = tmp_path / "x.tokens"
    w = seekable_tokens.TokenFileWriter(path.open("wb"))
    for i in range(5):
        w.add(i, np.arange(i * 100, dtype=np.uint32))
    w.close()
    with path.open("rb") as f:
        r = seekable_tokens.TokenFileReader(f, path.stat().st_size)
        assert [x.tolist() for _, x in r.read(np.array([1, 3, 4]))] == [list(range(i * 100)) for i in (1, 3, 4)]
    data = bytearray(path.read_bytes())
    data[int(r.stops[2]) + 20] ^= 1
    path.write_bytes(data)
    with path.open("rb") as f, pytest.raises(Exception, match="checksum|zstd|decompress|Corrupt|corrupt"):
        list(seekable_tokens.TokenFileReader(f, path.stat().st_size).read(np.array([3])))


def merged(model, pieces):
    """Plain merges over symbols, best score first, leftmost on ties."""
    symbols = list(pieces)
    score = {p: model.model.get_score(i) for p, (_, i) in model.pieces.items()}
    while True:
        best = max(((score[a + b], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in score), default=None)
        if best is None:
            return symbols
        k = -best[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


def all_paths(model, unit):
    """All segmentations with their scores: a junction that merges would not leave costs BREAK."""
    out = []

    def go(i, score, ids, last):
        if i == len(unit):
            out.append((score, ids))
        for b in range(i + 1, len(unit) + 1):
            if (p := unit[i:b]) in model.pieces:
                broken = last is not None and merged(model, last + p) != [last, p]
                go(b, score + model.pieces[p][0] - broken * piece_nbest.BREAK, ids + [model.pieces[p][1]], p)
        if i < len(unit) and unit[i] not in model.pieces:
            go(i + 1, score + model.low, ids + [model.bytes[x] for x in unit[i].encode()], None)

    go(0, 0.0, [], None)
    return sorted(out, key=lambda x: -x[0])


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from(list("abtheing  日é\n\x00")), max_size=8))
def test_nbest_equals_enumeration(text):
    model = lattice("piece_bpe_32k.model")
    want = all_paths(model, ("▁" + text.replace(" ", "▁")) if text else "")[:4]
    assert [s for s, _ in model.segment(text, 4)] == pytest.approx([s for s, _ in want], rel=1e-12)
    ids, stops, nbest = model.encode(pa.array([text]))
    assert [s for s, _ in nbest[0]] == pytest.approx([s for s, _ in want], rel=1e-12)
    every = {tuple(i) for _, i in all_paths(model, ("▁" + text.replace(" ", "▁")) if text else "")}
    assert len({tuple(x) for _, x in nbest[0]}) == len(nbest[0]) and all(tuple(x.tolist()) in every for _, x in nbest[0])
    assert nbest[0][0][1].tolist() == want[0][1] == model.model.encode(text) and model.decode(ids.tolist()) == text


def test_best_path_is_the_library_encoding_of_whole_texts():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    texts += [" " * 40 + "x", "a▁b", "日本語テキスト梦ゼ벨 mixed", "a" * 300, "=" * 90 + " " + "ab" * 50]
    model = lattice("piece_bpe_32k.model")
    ids, stops, nbest = model.encode(pa.array(texts))
    want = model.model.encode([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(np.append(0, stops[:-1]), stops, strict=True)] == want
    assert [len(n) for n in nbest if len(n) < 4] == [1] * sum(not t for t in texts)


def test_more_paths_and_decoding(spark, docs):
    rows = segment_texts(docs.filter("coalesce(length(text), 0) < 1000"), n=7)
    best = rows.select("doc_id", F.col("nbest")[0]["ids"].alias("ids"), F.size("nbest").alias("n"), F.lit("x").alias("decoded"))
    assert {r.n for r in best.collect()} == {1, 7}
    back = piece_nbest.decode_ids(best)
    assert back.columns == ["doc_id", "ids", "n", "decoded"]
    got = sorted((r.doc_id or 0, r.decoded) for r in back.collect())
    want = sorted((r[0] or 0, r[1] or "") for r in ROWS if len(r[1] or "") < 1000)
    assert got == want
    odd = spark.createDataFrame([(None,), ([],), ([1, 2, None, 40_000],)], "ids array<int>")
    assert [r.decoded for r in piece_nbest.decode_ids(odd).collect()] == [None, "", ""]


def test_segments_edge_rows(docs, no_docs):
    rows = segment_texts(docs).collect()
    assert len(rows) == len(ROWS) and all(r.round_trip for r in rows)
    empty = [r for r in rows if r.doc_id in (3, 4)]
    assert all(r.n_pieces == 0 and r.nbest_scores == [0.0] for r in empty)
    assert segment_texts(no_docs).count() == 0


def test_rows_of_one_id_go_to_several_files(spark):
    rows = spark.range(400).select(F.when(F.col("id") >= 100, F.lit(5)).alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = seekable_tokens.write_token_files(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = manifest.orderBy(F.col("first_id").asc_nulls_first(), "first_place").collect()
    assert len(files) > 1 and len({f.first_id for f in files}) < len(files)
    assert [f.first_token for f in files] == [sum(g.n_ids for g in files[:i]) for i in range(len(files))]
    back = seekable_tokens.read_token_files(manifest).collect()
    assert sorted((r.doc_id or 0) for r in back) == [0] * 100 + [5] * 300
    spans = sorted((r.start, r.start + r.n_tokens, r.doc_id or 0) for r in back)
    assert all(a[1] == b[0] and a[2] <= b[2] for a, b in zip(spans, spans[1:], strict=False))


def test_training_and_windows_by_brute_force():
    """A text's toxicity is that of its worst window, its language the mean over all windows."""
    from screenspark.llm import byte_cnn_lang, toxicity

    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 90, 40)]
    texts = [t + " badword" if i % 2 else t for i, t in enumerate(texts)]
    net = toxicity.train_net(texts, np.array([i % 2 for i in range(40)]), rounds=1, epochs=1)
    scorer = toxicity.Scorer(net)
    whole = scorer.score(pa.array(texts))
    for text, got in zip(texts, whole, strict=True):
        parts = text.split()
        starts = range(0, max(1, len(parts) - 16), 16) if len(parts) > 32 else [0]
        windows = [" ".join(parts[s : s + 32]) for s in starts]
        assert got == pytest.approx(max(scorer.score(pa.array([w]))[0] for w in windows), abs=1e-5)
    model = byte_cnn_lang.ByteCNN(["a", "b"])
    data = ("text " * 200).encode()
    windows = byte_cnn_lang.windows_of(data, byte_cnn_lang.WINDOW, 3)
    alone = [np.frombuffer(data[s : s + 256].ljust(256, b"\0"), np.uint8) for s in range(0, len(data) - 3, 253)]
    assert (windows == np.array(alone)).all()
    assert model.probabilities(windows).mean(axis=0) == pytest.approx(np.mean([model.probabilities(w[None])[0] for w in alone], axis=0), abs=1e-6)


def test_nbest_searches_backward_only_where_a_text_can_differ():
    """Of a junk text only the words that lose least are searched for other paths; the result is that of a search of all words."""
    model = piece_nbest.PieceLattice("piece_bpe_32k.model", 4)
    texts = [" ".join(hashlib.md5(f"{t}.{i}".encode()).hexdigest()[: 4 + i % 9] for i in range(300)) + "  \u0001 x" for t in range(3)]
    _, _, nbest = model.encode(pa.array([*texts, "", None, "   "]))
    assert len(model.part_index) < len(model.best_index) / 4
    whole = piece_nbest.PieceLattice("piece_bpe_32k.model", 4)
    for text, found in zip([*texts, "", "", "   "], nbest, strict=True):
        units = whole.units(pa.array([text]))[0].as_py()
        losses = [[s for s, _ in paths] + [-np.inf] * (4 - len(paths)) for paths in (whole.search(u, 4) if u else [(0.0, ())] for u in units)]
        least = piece_nbest.least_sums([[row[0] - s for s in row] for row in losses], 4)
        assert [s for s, _ in found] == [sum(row[0] for row in losses) - lost for lost, _ in least]
        assert found[0][1].tolist() == whole.model.encode(text)
        assert len({tuple(ids.tolist()) for _, ids in found}) == len(found)
