"""Operators that work document by document: media, tokens, personal data, toxicity."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kernmill.llm import media, pii, token_counts, token_store, toxicity
from kernmill.llm.common import shared_path
from tests.llm.conftest import EDGE, SF

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
#: Of each document of EDGE its id and text.
TEXTS = sorted(((i, t or "") for i, t, *_ in EDGE), key=str)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# ------------------------------------------------------------------------ media
@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_media_round_trip(data):
    payload = media.pad(data)
    assert len(payload) % 192 == 0 and media.decode(media.encode(payload)) == payload


def test_media_long_and_stuffed():
    for payload in (b"\xff" * 1920, bytes(range(256)) * 3, os.urandom(192 * (media.MAX_ROWS + 3))):
        stream = media.encode(payload)
        assert media.decode(stream) == payload
    assert stream.count(b"\xff\xd8\xff\xdb") == 2


def test_media_reads_ac_coefficients():
    """A stream with AC symbols, written by hand: two blocks, differences 5 and -3."""
    dc, ac = media.canonical([0, 3] + [0] * 14, [0, 2, 3]), media.canonical([0, 2, 1] + [0] * 13, [0, 0x01, 0x12])
    bits = ""
    for diff, coefficients in ((5, [(0, 1, "1"), (1, 2, "10")]), (-3, [])):
        size = abs(diff).bit_length()
        code, n = dc[size]
        bits += f"{code:0{n}b}" + f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}"
        for run, cat, extra in coefficients:
            code, n = ac[run << 4 | cat]
            bits += f"{code:0{n}b}" + extra
        code, n = ac[0]
        bits += f"{code:0{n}b}"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    stream = (
        b"\xff\xd8" + media._segment(0xDB, bytes([0] + [16] * 64)) + media._segment(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
        + media._segment(0xC4, bytes([0, 0, 3] + [0] * 14 + [0, 2, 3])) + media._segment(0xC4, bytes([16, 0, 2, 1] + [0] * 13 + [0, 1, 0x12]))
        + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    )
    assert media.thumbnails(media.parse(stream))[0].tolist() == [[128 + 10, 128 + 4]]


@pytest.mark.parametrize("size", [1, 500, 192 * 40, 192 * 300])
def test_media_equals_a_foreign_decoder(spark, size):
    """The JVM's own JPEG reader sees each block flat, in the payload's bytes."""
    payload = media.pad(random.Random(size).randbytes(size))
    image = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(media.encode(payload)))
    rows, columns = len(payload) // media.ROW, media.ROW
    assert (image.getWidth(), image.getHeight()) == (8 * columns, 8 * rows)
    raster = image.getRaster()
    for x, y in ((0, 0), (7, 7), (3, 5)):
        got = [raster.getSample(8 * c + x, 8 * r + y, 0) for r in range(min(rows, 4)) for c in range(columns)]
        assert got == list(payload[: len(got)])


def test_media_feature_is_a_grid():
    """Cell by cell, for thumbnails of any shape."""
    for shape in ((1, 192), (3, 192), (8, 8), (41, 192)):
        x = np.random.default_rng(shape[0]).integers(0, 256, shape).astype(np.uint8)
        cell = lambda i, n: slice(i * n // 8, max((i + 1) * n // 8, i * n // 8 + 1))
        means = [x[cell(i, shape[0]), cell(j, shape[1])].mean() for i in range(8) for j in range(8)]
        bits = "".join("1" if m > np.mean(means) else "0" for m in means)
        assert media.feature(x) == f"{shape[1]}x{shape[0]}:{int(bits, 2):016x}"


def test_media_rejects_others():
    good = media.encode(media.pad(b"abc"))
    for bad in (b"", b"GIF89a", good[:-4], good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_media_query(edge, none, clashing):
    got = {r["payload_sha256"]: r for r in media.features(media.store(edge)).collect()}
    for _, t in TEXTS:
        raw = t.encode()
        p = media.pad(raw)
        r = got[hashlib.sha256(p).hexdigest()]
        assert (r["n_bytes"] >= 0, r["payload_bytes"], r["tail_crc32"]) == (True, len(p), zlib.crc32(p[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.encode(p)).hexdigest()
    assert media.features(media.store(none)).count() == 0
    assert media.features(media.store(clashing)).count() == len(EDGE)


# ----------------------------------------------------------------------- tokens
def texts_for_tokens():
    rnd = random.Random(1)
    alphabet = "ab 1'st\n\t!é\x0b-<|Ωя \x85“—日\u0301\u2003\x1c"
    return [t for _, t in TEXTS] + ["don'T'll 'S", "a  ", " a", "İΣς", "x́", "<|startoftext|><|endoftext|>"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(800)]


def test_counts_equal_the_library(spark, sample):
    tokenizer, group = Tokenizer.from_file(BYTE), texts_for_tokens()
    want = [len(tokenizer.encode(t, add_special_tokens=False)) for t in group]
    lengths = token_counts.Lengths(BYTE, token_counts.frequent_table(sample, BYTE))
    assert lengths.counts(group) == want
    assert token_counts.Lengths(BYTE, {}).counts(group) == want  # all by the second tier
    assert all(len(w) <= token_counts.LONG for w in lengths.known)


def test_pre_tokens_equal_the_library():
    """Of every text, those with curly quotes, other scripts and odd white space as well."""
    tokenizer, splitter = Tokenizer.from_file(BYTE), token_counts.Splitter(BYTE)
    for t in texts_for_tokens():
        if "<|" not in t:
            assert splitter.split(t) == ([t[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(t)], 0)
    assert splitter.split("a<|endoftext|><|endoftext|> b") == (["a", " b"], 2)


def test_summary_keeps_what_is_frequent():
    rnd = random.Random(3)
    stream = [f"w{int(rnd.paretovariate(0.6)) % 100_000}" for _ in range(60_000)]
    summary = token_counts.Summary(200)
    for k in range(0, len(stream), 500):
        summary.add(stream[k : k + 500])
    for w, n in token_counts.Counter(stream).items():
        assert n - len(stream) / 200 <= summary.counts[w] <= n
    assert len(summary.counts) <= 2 * 200 + 500


def test_first_tier_holds_most_pre_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table, splitter = token_counts.frequent_table(docs, BYTE), token_counts.Splitter(BYTE)
    words = [w for r in docs.select("text").collect() for w in splitter.split(r["text"] or "")[0]]
    assert len(table) <= token_counts.FREQUENT and sum(w in table for w in words) / len(words) > 0.9


def test_ids_equal_the_library(monkeypatch):
    tokenizer, group = Tokenizer.from_file(WORD), texts_for_tokens()
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in group]
    assert token_store.Encoder(WORD).encode(group) == want
    monkeypatch.setattr(token_store, "CACHE", 10)  # forgetting changes nothing
    encoder = token_store.Encoder(WORD)
    assert [encoder.encode([t])[0] for t in group] == want


def test_different_pieces_are_looked_up_once():
    """Of a group of texts, whatever their number of pieces."""

    class Counted(dict):
        n = 0

        def get(self, *a):
            Counted.n += 1
            return super().get(*a)

        def __getitem__(self, key):
            Counted.n += 1
            return super().__getitem__(key)

    encoder = token_store.Encoder(WORD)
    encoder.cache = Counted(encoder.cache)
    for word in ("stone's", "stone’s"):
        group = [f" {word}  river\n" * 500, "", "River\t", f"river {word}"]
        want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(group, add_special_tokens=False)]
        assert encoder.encode(group) == want
    assert Counted.n < 40


def test_store_query(spark, edge, none, clashing):
    tokenizer = Tokenizer.from_file(WORD)
    ordered = sorted(((i, t or "") for i, t, *_ in EDGE), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, start = [], 0
    for i, t in ordered:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for docs in (edge, clashing):
        path = shared_path(spark, "test")
        token_store.write(docs, path, WORD, files=3)
        assert rows(token_store.digest(token_store.read(spark, path)), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    path = shared_path(spark, "test")
    token_store.write(none, path, WORD)
    assert token_store.digest(token_store.read(spark, path)).count() == 0


def test_store_files_are_indexed(spark, sample):
    import glob

    import pyarrow.parquet as pq

    path = shared_path(spark, "test").removeprefix("file:")
    token_store.write(sample, path, WORD, files=2)
    firsts = []
    for f in sorted(glob.glob(f"{path}/*.parquet")):
        meta = pq.ParquetFile(f).metadata
        column = meta.row_group(0).column(meta.num_columns - 1)
        assert any("DICTIONARY" in e for e in column.encodings) and column.has_offset_index and column.has_column_index
        ids = pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids)
        firsts.append(ids[0])
    assert firsts == sorted(firsts)


# ---------------------------------------------------------------- personal data
SCANS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def scanned(text):
    out = []
    for kind in pii.BASE:
        for m in re.finditer(SCANS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="a1.@-+ ()_%é", max_size=40), st.text(alphabet="0123456789 -.", max_size=60), st.text(alphabet="+1 (23)-4.@b", max_size=40)))
def test_base_spans_equal_plain_scans(text):
    assert [s for s in pii.spans(text) if s[0] in pii.BASE] == scanned(text)


def test_added_spans_and_redaction():
    text = 'See https://user@host.example.org:80/a?b=1. Account no: AB12-34567, token = "24be64439e3e49cf46b2" é www.foo.org'
    kinds = [(k, text[a:b]) for k, a, b in pii.spans(text)]
    assert ("address", "https://user@host.example.org:80/a?b=1") in kinds and ("address", "www.foo.org") in kinds
    assert ("account", "AB12-34567") in kinds and ("account", "24be64439e3e49cf46b2") in kinds
    assert pii.redact("a b@c.de, 1.2.3.4") == "a [EMAIL], [IP]"
    assert pii.redact("clean words") == "clean words"


@pytest.mark.parametrize("unit", ["www.", "www.a,", "http://", "a@", "+1 ", "account ", "1.1.1.", "://a.", "a.www.b..", "token\t"])
def test_personal_data_in_linear_time(unit):
    import time

    spent = []
    for n in (20_000, 160_000):
        began = time.perf_counter()
        pii.spans(unit * n)
        spent.append(time.perf_counter() - began)
    assert spent[1] < 8 * 4 * max(spent[0], 0.02)


def test_pii_query(edge, none, clashing, sample):
    got = {r["doc_id"]: r for r in pii.find(edge).collect()}
    r = got[9]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[4]["spans"] == ""
    for r in pii.find(sample).join(sample, "doc_id").collect():
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in scanned(r["text"]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base)
    assert pii.find(none).count() == 0 and pii.find(clashing).count() == len(EDGE)
    clean = {r["doc_id"]: r for r in pii.redacted(clashing).collect()}
    assert "[CARD]" in clean[9]["text"] and clean[9]["n_chars"] == len(clean[9]["text"]) and clean[3]["text"] is None and clean[9]["slot"] == "clash"


# --------------------------------------------------------------------- toxicity
def small_model():
    words = "a plain idiot and a stupid loser went to the trash with a pathetic clown " * 50
    n = toxicity.trigrams([words]).astype(float).reshape((toxicity.SIZE,) * 3)
    pair = n.sum(axis=0) + 1
    low = pair / pair.sum(axis=1, keepdims=True)
    logp = np.log((n + 4 * low) / (n.sum(axis=2, keepdims=True) + 4)).astype(np.float32)
    return toxicity.Model(logp, dict.fromkeys(("idiot", "stupid", "loser", "trash", "pathetic", "clown"), 6.0), -4.0)


@pytest.mark.parametrize("text", ["IDIOT!", "1d10t", "l0s3r,", "p@thetic", "i d i o t", "stuuuupid", "s.t.u.p.i.d", "st*pid", "cl0wnnn", "tr@5h", "1 d 1 0 t", "id-iot", "(idiot)"])
def test_deobfuscation(text):
    assert small_model().scores([f"well {text} then"])[0] > 0.5


@pytest.mark.parametrize("text", ["", "plain words 1984", "Of%%% athe*** of", "24be64439e3e49cf46b2d7c90f3602a3", "a a a a a a a", "x" * 5000, "1234 5678"])
def test_clean_texts_stay(text):
    assert small_model().scores([text])[0] < 0.1


@pytest.mark.parametrize("text", ["a l o s e r", "s t u p i d i d i o t", "i\td\ti\to\tt", "i  d \n i o t", "i d i o t, and", "i d i o t !", "a a a " + "w e n t t o t h e " * 20 + "t r a s h " + "w i t h " * 20])
def test_deobfuscation_of_runs(text):
    assert small_model().scores([f"well {text} then"])[0] > 0.5


@pytest.mark.parametrize("text", ["stuppid", "iddiot", "ttrash,", "losser!", "(cllown)"])
def test_deobfuscation_of_doubled_letters(text):
    assert small_model().scores([f"well {text} then"])[0] > 0.5


def test_words_of_digits_and_common_doubles():
    model = small_model()
    model.weights |= {"toast": 6.0, "ass": 6.0, "god": 6.0}
    assert model.words(["70457 4$$", "455", "1984 1234 5678 2026-11-26 10:30 100%"], known=True) == [{"toast", "ass"}, {"ass"}, set()]
    assert model.words(["good"], known=True) == [{"god"}]
    assert toxicity.Model(model.logp, model.weights, -4.0, common=frozenset(["good"])).words(["good iddiot"], known=True) == [{"idiot"}]


def test_short_runs_and_words_within_words():
    model = small_model()
    assert model.words(["h e r e i d i o t s t u p i d"], known=True) == [{"idiot", "stupid"}]
    model = toxicity.Model(model.logp, {"fat": 6.0, "oaf": 6.0, "pathetic": 6.0, "path": 6.0}, -4.0)
    assert model.words(["so f a t", "o @ f", "p a t h e t i c", "w e n t t o p a t h"], known=True) == [{"fat"}, {"oaf"}, {"pathetic"}, {"path"}]


def test_viterbi_finds_the_likeliest():
    """Against all readings of a lattice, scored one by one."""
    from itertools import product

    m = small_model()
    segments = toxicity.lattice("1d!0ot")
    best = []
    for choice in product(*segments):
        word = "".join(c for c, _ in choice)
        z = [0, 0, *[int(toxicity._CLASS[ord(c)]) for c in word], 0]
        best.append((sum(float(m.logp[a, b, c]) for a, b, c in zip(z, z[1:], z[2:], strict=False)) + sum(p for _, p in choice), word))
    got = toxicity.decode(segments, m.logp)
    assert got[0][1] == max(best)[1] and abs(got[0][0] - max(best)[0]) < 1e-4


def test_training_and_scores(spark, sample, none, clashing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(sample, labels)
    out = toxicity.scored(sample, model).join(labels, "doc_id").toPandas()
    clean, toxic = out[out.toxic == 0], out[out.toxic == 1]
    assert clean.predicted.mean() <= 0.02 and out.score.between(0, 1).all()
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id}
    assert all(held[i] == h for i, h in zip(out.doc_id, out.held_out, strict=True))
    assert len(toxic) == 0 or toxic.score.mean() >= clean.score.mean()
    assert toxicity.scored(none, model).count() == 0
    assert toxicity.scored(clashing, model).count() == len(EDGE)
    assert toxicity.accepted(clashing, model).columns == clashing.columns
    untrained = toxicity.train(clashing, labels.limit(0))
    assert {r["predicted"] for r in toxicity.scored(clashing, untrained).collect()} == {0}


def test_held_out_recall(spark):
    """On held-out labels of a larger table, for documents that hold a word with a
    weight and for all; and what training left out decides nothing else."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    out = toxicity.scored(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    clean, toxic = out[out.toxic == 0], out[out.toxic == 1]
    assert clean.predicted.mean() < 0.01 and toxic.predicted.mean() > 0.75
    assert model.ridge in toxicity.RIDGES


@pytest.mark.parametrize("token", ["s.t" + ".u" * 30 + ".p.i.d", "1" * 200_000, "ab1$" * 25_000, "idiot,moron1d10t", "(st*pid)/x" + "9z" * 60])
def test_tokens_of_any_length(token):
    """No token is too long to be read; what a lattice can't hold parts it."""
    found = small_model().words([f"well {token} then"], known=True)[0]
    assert found == {w for w, c in (("stupid", "u.p.i.d" in token or "st*pid" in token), ("idiot", "1d10t" in token)) if c}


def test_logistic_equals_descent():
    """The least of the penalised loss, against plain gradient descent."""
    rng = np.random.default_rng(4)
    dense = rng.random((200, 6)) < 0.3
    y = (rng.random(200) < np.where(dense[:, 0], 0.8, 0.2)).astype(float)
    w, b = toxicity.logistic([np.flatnonzero(r).tolist() for r in dense], y, 6, 0.5)
    v, c = np.zeros(6), 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(dense @ v + c)))
        v, c = v - 0.02 * (dense.T @ (p - y) + 0.5 * v), c - 0.02 * (p - y).sum()
    assert np.allclose(w, v, atol=1e-5) and abs(b - c) < 1e-5
