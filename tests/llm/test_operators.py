"""Every operator against a brute-force version, on tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import io
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvloom.llm import bpe, components, crf, embed_dedup, lang_id, media, mixing, ngram_join, secrets, sharding, suffix_dedup, toxicity

from .data import empty, frame, texts

TEXTS = texts()


def groups(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- 1 ---------------------------------------------------------------------------


def shingles(text):
    w = text.encode().lower().split() if text else []
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_ngram_join_is_brute_force(spark):
    got = {r.doc_id: r for r in ngram_join.jaccard_components(frame(spark)).collect()}
    sets = [shingles(t) for t in TEXTS]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    part = groups(links, range(len(sets)))
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id) == (len(s), part[i])
        assert got[i].n_links == sum(i in p for p in links)
    assert len(links) > 30


def test_ngram_join_in_many_blocks(spark, monkeypatch):
    whole = {tuple(r) for r in ngram_join.jaccard_components(frame(spark)).collect()}
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 4)
    monkeypatch.setattr(ngram_join, "COLUMNS", 64)
    for fragments in (1, 7):
        monkeypatch.setattr(ngram_join, "FRAGMENTS", fragments)
        assert {tuple(r) for r in ngram_join.jaccard_components(frame(spark)).collect()} == whole


def test_ngram_join_edges(spark):
    assert ngram_join.jaccard_components(empty(spark)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A B C D E F"), (4, None)]
    got = sorted((r.doc_id or -1, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows)).collect())
    assert got == [(-1, None), (3, 3), (3, 3), (4, 4), (9, 3)]
    kept = ngram_join.keep_one(frame(spark, rows))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 4] and kept.columns == frame(spark).columns
    # One id with different texts: each is judged by itself, and none is lost.
    rows = [(5, "q w e r t y"), (5, "a b c d e f"), (5, "a b c d e f"), (6, "a b c d e f"), (7, "q w e r t y"), (5, ""), (5, None), (8, "z")]
    kept = sorted((r.doc_id, r.text or "") for r in ngram_join.keep_one(frame(spark, rows)).collect())
    assert kept == [(5, ""), (5, "a b c d e f"), (5, "q w e r t y"), (8, "z")]
    assert {(r.doc_id, r.n_links) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()} == {(5, 1), (5, 2), (5, 0), (6, 2), (7, 1), (8, 0)}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {x.id: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(edges, {x for e in edges for x in e})
    assert got == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in edges)}


# --- 2 and 5 ---------------------------------------------------------------------


def labelled(spark, n=600):
    r = random.Random(2)
    stock = {"en": [f"the{c}ing" for c in "abcdefghij"], "de": [f"und{c}lich" for c in "abcdefghij"]}
    docs, labels = [], []
    for i in range(n):
        lang = r.choice(("en", "de"))
        w = [r.choice(stock[lang]) for _ in range(r.randrange(5, 60))]
        toxic = r.random() < 0.2
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(("vile", "vilest", "scoundrel")))
        docs.append((i, " ".join(w) + ".", lang))
        labels.append((i, int(toxic)))
    docs += [(n, None, "en"), (n + 1, "", None), (n + 2, "123 !", "en")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels + [(7, None), (None, 1)], "doc_id long, toxic int"), dict(labels)


def test_forward_backward_is_enumeration():
    r = np.random.default_rng(1)
    k, lengths = 3, np.array([1, 4, 2])
    scores, moves, starts = r.normal(size=(7, k)), r.normal(size=(k, k)), r.normal(size=k)
    got = crf.forward_backward(scores, lengths, moves, starts)
    at = 0
    for n in lengths:
        total = np.zeros((n, k))
        for path in np.ndindex(*[k] * n):
            w = np.exp(starts[path[0]] + sum(scores[at + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                total[t, y] += w
        assert np.allclose(got[at : at + n], total / total.sum(axis=1, keepdims=True))
        at += n


def test_language(spark):
    docs, _, _ = labelled(spark)
    got = lang_id.predict(docs, lang_id.fit(docs)).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out and r.text and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98 and len(held) > 80
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id >= 600} == {600: ("und", 0.0), 601: ("und", 0.0), 602: ("und", 0.0)}
    assert [r.lang_pred for r in lang_id.predict(docs.limit(3), lang_id.fit(docs.where("false"))).collect()] == ["und"] * 3
    assert lang_id.keep_known(docs, lang_id.fit(docs)).count() == 600
    assert lang_id.predict(empty(spark), None).count() == 0


def test_texts_of_no_learned_language_go(spark):
    """Random letters and a language outside the sample go, whatever the number of labels; learned and code-switched texts stay."""
    r = random.Random(11)
    heads = {"en": ["the", "and", "th", "wh", "ing", "sh"], "de": ["und", "der", "sch", "ein", "pf", "ung"], "fr": ["eau", "que", "oir", "é", "les", "aux"]}
    say = lambda lang, n=40: " ".join("".join(r.choice(heads[lang]) for _ in range(r.randrange(1, 3))) for _ in range(n))
    noise = lambda n=40: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 10))) for _ in range(n))
    for learned in (("en",), ("en", "de")):
        rows = [(i, say(learned[i % len(learned)]), learned[i % len(learned)]) for i in range(200)]
        rows += [(1000 + i, noise(), None) for i in range(30)] + [(2000 + i, say("fr"), None) for i in range(30)]
        rows += [(3000 + i, say(learned[0], 20) + " " + say(learned[-1], 20), None) for i in range(30)] + [(4000, "zq xj", None), (4001, "12 !", None), (4002, "\u043c\u0438\u0440 " * 20, None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        kept = {x.doc_id for x in lang_id.keep_known(docs, lang_id.fit(docs)).collect()}
        assert kept == {*range(200), *range(3000, 3030), 4000}


def test_code_switching():
    field = crf.Field(["de", "en"], lang_id.WordFeatures({}))
    sample = ["the cat sat here. it was the best", "und der hund lief weg. das war gut"] * 40
    field.fit(sample, lambda d, w: d % 2 == 0, epochs=6)
    own, _, p = crf.Tagger(field)(["the cat und der hund"])
    assert p.argmax(axis=1).tolist() == [1, 1, 0, 0, 0]


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if truth.get(r.doc_id) and r.offsets:
            assert {text[r.doc_id][int(a) : int(b)] for a, b in (s.split(":") for s in r.offsets.split(","))} <= {"vile", "vilest", "scoundrel"}
    assert [r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).take(2)] == [0, 0]


def test_long_chains_are_enumeration_too(monkeypatch):
    """Chains cut into pieces give what one walk gives."""
    r = np.random.default_rng(3)
    lengths = np.array([1, 4, 2, 17, 9, 3, 301])
    scores, moves, starts = r.normal(size=(lengths.sum(), 3)) * 4, r.normal(size=(3, 3)), r.normal(size=3)
    whole = crf.forward_backward(scores, lengths, moves, starts)
    for piece in (1, 2, 5, 16):
        monkeypatch.setattr(crf, "PIECE", piece)
        assert np.allclose(crf.forward_backward(scores, lengths, moves, starts), whole)


def test_words_of_two_generations():
    field = crf.Field(["a", "b"], lang_id.WordFeatures({}))
    field.weights += np.random.default_rng(4).normal(size=field.weights.shape).astype(np.float32)
    r = random.Random(4)
    batches = [[" ".join(f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}Q" for _ in range(40))] for _ in range(30)]
    plain, small = crf.Tagger(field), crf.Tagger(field, lambda w: len(w), cached=60)
    for b in batches:
        assert np.allclose(plain(b)[2], small(b)[2]) and (small.marked == 4).all()
    assert len(small.words) < 200


def test_sample_is_bounded_and_skips_absent_documents(spark):
    rows = [(1, f"text {i % 3}", "en") for i in range(500)] + [(i, f"other {i}", "en") for i in range(2, 400)] + [(2, "third", "de"), (3, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plain = docs.where("text is not null").select("doc_id", "lang")
    sample = crf.training_sample(plain, docs, "lang", 50)
    assert len([t for t, y in sample if y == "en"]) <= 50 and [t for t, y in sample if y == "de"] in (["third"], [])
    assert sample == crf.training_sample(plain, docs.repartition(5), "lang", 50)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(5000, 9000)] + [(i, int(i % 2)) for i in range(400)], "doc_id long, toxic int")
    ids = docs.where("text is not null").select("doc_id").join(labels, "doc_id")
    assert len(crf.training_sample(ids, docs, "toxic", 1000)) > 250


def test_language_and_toxicity_at_the_edges(spark):
    """Extra columns with clashing names, repeated rows, null ids, very long texts without an end mark, empty tables."""
    docs, labels, _ = labelled(spark)
    field, model = lang_id.fit(docs), toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(900, "theaing " * 60_000, "en"), (901, "undblich theaing", None), (901, "undblich theaing", None), (None, "thebing", None)], docs.schema)
    wide = odd.select("*", *[F.lit(7).alias(c) for c in ("score", "offsets", "lang_pred", "held_out", "keep_language0", "n_masked0", "predicted")])
    for run, fitted in ((lang_id.predict, field), (toxicity.score, model)):
        got = sorted(map(tuple, run(wide, fitted).collect()), key=str)
        assert got == sorted(map(tuple, run(odd, fitted).collect()), key=str) and len(got) == 4
        assert run(docs.where("false"), fitted).count() == 0
    assert lang_id.keep_known(wide, field).columns == wide.columns and lang_id.keep_known(wide, field).count() == 4
    masked = secrets.mask(wide.withColumn("n_chars", F.lit(1)))
    assert masked.columns == [*wide.columns, "n_chars"] and masked.count() == 4
    assert {r.lang_pred for r in lang_id.predict(odd, field).where("doc_id = 900").collect()} == {"en"}


# --- 3 ---------------------------------------------------------------------------


def test_secret_base_patterns(spark):
    rows = [
        (0, 'password = "abcdef123456" and TOKEN:xyz'), (1, "AKIA" + "Z9" * 8), (2, "é x" + "0a" * 8 + "g" + "f" * 15), (3, None), (4, ""),
        (5, "Api_Key=" + "k" * 12 + " secret'=\"" + "0123456789ab" * 2), (6, "aſecret=abcdefghijklmnop"), (7, "hJ8kQ2xZ7vB4nM9cR3tY6wL1pD5s"), (8, "deadbeef" * 5),
        (9, "123e4567-e89b-12d3-a456-426614174000 some_long_identifier_name_here"),
    ]
    got = {r.doc_id: r for r in secrets.scan(frame(spark, rows)).collect()}
    spans = {i: got[i].spans for i in got}
    assert spans[0] == "assign:0:24" and spans[1] == "access:0:20" and spans[2] == "hex:3:19" and spans[3] == spans[4] == ""
    assert spans[5].split(",")[0] == "assign:0:20" and "assign" in spans[5].split(",")[1] and spans[6] == ""
    assert spans[7] == "random:0:28" and spans[8] == "hex:0:40" and spans[9] == ""
    assert got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[0].base_sha256 == hashlib.sha256(b"assign:0:24").hexdigest()


def test_secret_base_is_the_plain_patterns():
    r = random.Random(8)
    pieces = ["password", "Token", "api_key", "=", ": ", '"', "AKIA", "ABC123", "0f1e", "a", " ", "z9_", "é"]
    for _ in range(3000):
        t = "".join(r.choice(pieces) for _ in range(r.randrange(1, 25)))
        want = [(m.start(), m.end(), "assign") for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert sorted(secrets.base_spans(t)) == sorted(want)


def test_random_strings_beside_words_and_base_spans():
    import public_tokenizers

    enc = secrets.encoding(public_tokenizers.path(secrets.VOCABULARY))
    r = random.Random(12)
    scan = lambda t: secrets.random_spans(t, secrets.base_spans(t), enc)
    heads = ("users/profile/settings/download/documents/", "repository/archive/releases/production/configuration/credentials/", "0123456789abcdef01/")
    for head in heads:
        missed = 0
        for n in [20, 24, 32] * 40:
            key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
            spans = scan(head + key + "/archive/documents")
            missed += not any(a <= len(head) and b >= len(head) + n for a, b, _ in spans)
        assert missed == 0, head
    split = "repository/archive/releases/production/configuration/credentials/Xq9-vB7_kZ2-Lp4_Wt8-Rj3/archive/documents/configuration/credentials/production/repository/releases/download"
    assert [split[a:b] for a, b, _ in scan(split)] == ["Xq9-vB7_kZ2-Lp4_Wt8-Rj3"]
    for plain in ("repository/archive/releases/production/configuration/credentials/123e4567-e89b-12d3-a456-426614174000/documents/repository/releases", "archive/Production_Configuration/releases/2024-01-02T03-04-05Z/documents", "some_long_identifier_name_here/with/Many/More/words2/in/it"):
        assert scan(plain) == [], plain
    began = time.time()
    scan("a1-B2_c/" * 20_000)
    assert time.time() - began < 30


def test_mask(spark):
    docs = frame(spark, [(1, 'x password="abcdef123456" y'), (2, None), (None, "plain")])
    got = secrets.mask(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in got.collect()) == [("1", 'x [assign]" y', 13), ("2", None, None), ("None", "plain", 5)]


# --- 4 ---------------------------------------------------------------------------


def test_vectors_are_brute_force(spark, monkeypatch):
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = base[i % 12] + r.normal(size=16) * r.choice([0.05, 0.1, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v], i % 3 if i % 12 else None))
    rows += [(1000 + i, rows[1][1], 1) for i in range(30)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, [], 1), (2005, rows[1][1][:4], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("vec_id", "cast(embedding as array<float>) embedding", "label", "label as copies", "vec_id as digest")
    able = [(i, np.array(v), c) for i, v, c in rows if c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    for n, (i, v, c) in enumerate(able):
        for j, w, e in able[:n]:
            if c == e and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links.append((j, i))
    part = groups(links, [i for i, _, _ in rows])
    for block in (1024, 8):
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        got = {x.vec_id: x for x in embed_dedup.near_vectors(df).collect()}
        n = sum(x.n_links for x in got.values())
        assert 0.995 * 2 * len(links) <= n <= 2 * len(links) and len(got) == len(rows)
        assert np.mean([got[i].component_id == part[i] for i in got]) > 0.995
        assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())
    assert embed_dedup.near_vectors(df.where("false")).count() == 0


def test_vectors_at_the_ends_of_the_double_range(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1.01e200], 1), (3, [1e-200, 1e-200], 1), (4, [5e-324, 5e-324], 1), (5, [1e200, -1e200], 1), (6, [0.0, 0.0], 1)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


# --- 6 ---------------------------------------------------------------------------


def test_bpe_is_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    r = random.Random(6)
    letters = "aaabcdeehhistt'  .,!?%ÄäßΣσς́é́ İı\x1c\x85　中🙂½²ⅷ12_<|>endoftext\n"
    rows = [*TEXTS, "<|endoftext|>", "x<|startoftext|>y", "a" * 3000, *["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(2000)]]
    got = {x.doc_id: x for x in bpe.encode_digests(frame(spark, list(enumerate(rows)))).collect()}
    for i, text in enumerate(rows):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), text
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(frame(spark, [(1, None)])).collect()[0].ids == "" and bpe.encode_digests(empty(spark)).count() == 0


def test_bpe_table_is_deterministic_and_may_be_emptied(monkeypatch):
    enc = bpe.encoder()
    words = ["tokenization", "a" * 3000, "the", "zq9x", "internationally", "ion", "th"]
    paths = [enc.automaton.path(w) for w in words]
    row = enc.automaton.start["t"][0]
    assert row is enc.automaton.start["t"][0] and row["h"][1] == enc.automaton.ids["th"]
    monkeypatch.setattr(bpe, "ROWS", 3)
    assert [enc.automaton.path(w) for w in words] == paths and len(enc.automaton.rows) < 3000
    # Each pair of neighbours is an arc, and every path spells its word.
    for word, path in zip(words, paths):
        assert "".join(enc.automaton.text[i] for i in path) == word + bpe.END
        assert all(enc.automaton.arc(a, b) for a, b in zip(path, path[1:]))


# --- 7 ---------------------------------------------------------------------------


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def test_mixing(spark):
    r = random.Random(9)
    rows = [(i, None if i % 50 == 0 else " ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(0, 60)))) for i in range(4000)]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    again = {tuple(x) for x in mixing.mix(docs.repartition(7)).collect()}
    assert {tuple(x) for x in got} == again and len(got) == len(rows)
    sizes = {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x["size"]
    want = targets(sizes)
    for s in sizes:
        own = [x for x in got if x.source == s]
        assert own[0].source_size == sizes[s] and own[0].target == pytest.approx(want[s])
        assert abs(sum(x["size"] * x.copies for x in own) - want[s]) <= 60
    assert all(0 <= x.copies <= 2 for x in got)
    copies = sum(x.copies for x in got)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and out.count() == copies
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix(frame(spark, [(1, None), (2, "")])).count() == 2


# --- 8 ---------------------------------------------------------------------------


def plain_passages(rows):
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda x: x[0]):
        raw = (text or "").encode()
        grams = [raw[s : s + 50] for s in range(len(raw) - 49)]
        mask = bytearray(len(raw))
        for s, g in enumerate(grams):
            if g in seen and seen[g] < i:
                mask[s : s + 50] = b"\x01" * 50
        for g in grams:
            seen.setdefault(g, i)
        out[i] = (len(raw), sum(mask), len(re.findall(b"\x01+", bytes(mask))), hashlib.sha256(bytes(b for b, m in zip(raw, mask) if not m)).hexdigest())
    return out


def test_passages_are_brute_force(spark, monkeypatch):
    r = random.Random(10)
    rows = list(enumerate(TEXTS))
    shared = ["".join(chr(r.randrange(97, 123)) for _ in range(n)) for n in (49, 50, 51, 120, 400)]
    for i in range(60):
        rows.append((500 + i, "".join(r.choice([*shared, "é🙂", "a" * r.randrange(70), f" {r.random()} "]) for _ in range(6))))
    want = plain_passages(rows)
    for batch, hot, most in ((400_000, 16, 4096), (300, 2, 40)):
        for name, value in (("BATCH_STRINGS", batch), ("HOT_TEXTS", hot), ("MOST_STRINGS", most)):
            monkeypatch.setattr(suffix_dedup, name, value)
        got = suffix_dedup.repeated_passages(frame(spark, rows)).collect()
        assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == want
    assert sum(v[1] for v in want.values()) > 10_000
    assert suffix_dedup.repeated_passages(empty(spark)).count() == 0
    odd = suffix_dedup.repeated_passages(frame(spark, [(None, "x" * 80), (5, "x" * 80), (5, "x" * 80), (6, "x" * 80)])).collect()
    assert sorted((x.doc_id or -1, x.n_removed) for x in odd) == [(-1, 0), (5, 0), (5, 0), (6, 80)]


def test_passages_of_one_id_with_different_texts(spark):
    r = random.Random(20)
    letters = lambda n: "".join(chr(r.randrange(97, 123)) for _ in range(n))
    passage, tail, other = letters(100), letters(80), letters(60)
    rows = [(1, passage), (5, passage + tail), (5, other), (5, passage + tail)]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256) for x in suffix_dedup.repeated_passages(frame(spark, rows)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(1, 100, 0, sha(passage)), (5, 60, 0, sha(other)), (5, 180, 100, sha(tail)), (5, 180, 100, sha(tail))])


def test_anchors_of_texts_together_are_those_of_each():
    r = random.Random(31)
    raws = [bytes(r.randrange(97, 100) for _ in range(r.choice((0, 1, 19, 49, 50, 51, 90, 700, 40_000)))) for _ in range(80)]
    got = list(suffix_dedup.each_anchors(iter(raws), 50, 20))
    assert [raw for raw, _ in got] == raws and list(suffix_dedup.each_anchors([], 50, 20)) == []
    for raw, a in got:
        assert a.tolist() == suffix_dedup.anchors(raw).tolist()
        f = suffix_dedup.fingerprints(raw, 20).tolist()
        assert len(raw) > 1000 or a.tolist() == [min(f[i : i + 31]) for i in range(len(raw) - 49)]


def test_anchors_of_many_short_texts_take_few_calls(monkeypatch):
    """200 texts of 100 bytes were 200 calls on short arrays."""
    calls, plain = [], suffix_dedup.anchors
    monkeypatch.setattr(suffix_dedup, "anchors", lambda *a: calls.append(1) or plain(*a))
    assert len(list(suffix_dedup.each_anchors([b"x" * 100] * 200, 50, 20))) == 200 and len(calls) == 1


def test_strings_with_zero_bytes_are_told_apart():
    raw = b"ab" + b"\0" * 6
    s = suffix_dedup.strings_at(raw, np.arange(5), 4)
    assert [a == b for a, b in zip(s[:-1], s[1:])] == [raw[i : i + 4] == raw[i + 1 : i + 5] for i in range(4)]


def test_family_levels_double():
    family, r = suffix_dedup.Family(), np.random.default_rng(1)
    for i in range(40):
        p = np.unique(r.integers(0, 256, (100, 50)).astype(np.uint8).view("S50").ravel())
        family.add(p, np.full(p.size, i))
    sizes = [level[0].size for level in family.levels]
    assert sum(sizes) > 3900 and all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) < 8


# --- 9 ---------------------------------------------------------------------------


def test_media_round_trip(spark):
    for form in ("pgm", "bmp"):
        got = {r.doc_id: r for r in media.media_features(media.text_media(frame(spark), form)).collect()}
        for i, text in enumerate(TEXTS):
            payload = media.text_payload(text)
            assert (got[i].payload_bytes, got[i].payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
            assert got[i].tail_crc32 == zlib.crc32(payload[-32:]) and len(payload) % 576 == 0 and got[i].n_bytes == len((text or "").encode())
    assert media.text_media(empty(spark)).count() == 0


def test_decoders():
    r = np.random.default_rng(2)
    grey = r.integers(0, 256, (7, 5)).astype(np.uint8)
    colour = r.integers(0, 256, (3, 5, 3)).astype(np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_bmp(grey)) == grey).all()
    assert (media.decode(b"P6 5 3 255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P3 # c\n5 3 255\n" + b" ".join(b"%d" % x for x in colour.ravel())) == colour).all()
    assert media.decode(b"P1\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    row = np.zeros((3, 16), np.uint8)
    row[:, :15] = colour[::-1, :, ::-1].reshape(3, 15)
    import struct

    bmp = struct.pack("<2sIHHI", b"BM", 54 + row.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, 24, 0, row.size, 0, 0, 0, 0) + row.tobytes()
    assert (media.decode(bmp) == colour).all()


def test_area_resize_is_exact_area():
    x = np.arange(24.0).reshape(4, 6)
    assert np.allclose(media.area_resize(x, 2, 3), x.reshape(2, 2, 3, 2).mean(axis=(1, 3)))
    fine = np.repeat(np.repeat(x, 3, axis=0), 5, axis=1)
    assert np.allclose(media.area_resize(x, 3, 5), fine.reshape(3, 4, 5, 6).mean(axis=(1, 3)))


def test_tiles(spark):
    import io

    rows = [(1, bytearray(media.encode_pgm(np.arange(50 * 30, dtype=np.uint8).reshape(50, 30)))), (2, bytearray(b"junk")), (3, None)]
    got = media.media_tiles(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert len([r for r in got if r.doc_id == 1]) == 6 and all(r.error for r in got if r.doc_id != 1)
    assert np.load(io.BytesIO(next(r.npy for r in got if (r.tile_row, r.tile_col) == (2, 1)))).shape == (2, 6)


# --- 10 --------------------------------------------------------------------------


def test_shards(spark):
    docs = frame(spark)
    for cell in (20_000, 6):
        got = sharding.shard(docs, 16 if cell > 6 else 3, cell).collect()
        assert len(got) == len(TEXTS)
        by_text, slots = {}, {}
        for r in got:
            text = TEXTS[r.doc_id]
            assert r["size"] == len((text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text or "").encode())
            assert by_text.setdefault(text, r.shard) == r.shard
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty(spark)).count() == 0


def test_shards_are_balanced(spark):
    """Bytes near equal in the query's path. Cells of 100 groups leave 16 shards six groups each to level out, so their bound is wide; the query's hold 20,000."""
    r = random.Random(6)
    rows = [(i if i % 40 else None, "x" * int(min(r.paretovariate(1.3) * 50, 4000)) + str(i % 1500)) for i in range(2000)]
    for cell, part in ((20_000, 0.001), (100, 0.05)):
        got = sharding.shard(frame(spark, rows), 16, cell).collect()
        size, shards = {}, {}
        for x in got:
            size[x.shard] = size.get(x.shard, 0) + x["size"]
            shards.setdefault(x.text_crc32, set()).add(x.shard)
        assert len(got) == 2000 and len(size) == 16 and all(len(s) == 1 for s in shards.values())
        assert max(size.values()) - min(size.values()) <= part * sum(size.values()) / 16


def test_differencing_beats_dealing():
    r = random.Random(1)
    sizes = [int(r.paretovariate(1.5) * 100) for _ in range(2000)]
    places, sums = sharding.difference([(s, 0, 0, 0) for s in sizes], 4)
    parts = [0] * 4
    for s, p in zip(sizes, places):
        parts[p[0]] += s
    assert sorted(parts) == sorted(sums) and max(parts) - min(parts) <= 2
    assert sharding.difference([(5, 0)], 2)[1] in ([5, 0], [0, 5])


def test_query_stores_texts_as_npy_tiles(spark):
    """op9's rows are folds of the rows of media_tiles, by PGM and by BMP alike, and a change in one tile shows in the feature."""
    text = "".join(chr(33 + (i * i) % 90) for i in range(5 * media.UNIT))
    rows = [(1, text), (2, text[:-1] + "~"), (3, None), (4, "short"), (5, text[: 2 * media.UNIT])]
    seen = []
    for form in ("pgm", "bmp"):
        stored = media.text_media(frame(spark, rows), form)
        got = {x.doc_id: x for x in media.media_features(stored).collect()}
        cut = media.media_tiles(stored).orderBy("doc_id", "tile_row", "tile_col").collect()
        for i, t in rows:
            own = [x for x in cut if x.doc_id == i]
            payload = b"".join(np.load(io.BytesIO(x.npy)).tobytes() for x in own)
            assert payload == media.text_payload(t) and len(own) == len(payload) // media.UNIT
            raw = b"".join(bytes(x.npy) for x in own)
            assert (got[i].payload_sha256, got[i].tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
            assert (got[i].media_bytes, got[i].media_sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
            hashes = b"".join((media.difference_hash(np.load(io.BytesIO(x.npy)))).to_bytes(8, "big") for x in own)
            assert hashes == b"".join((x.tile_hash % (1 << 64)).to_bytes(8, "big") for x in own)
            assert got[i].feature.split(":")[1:3] == [str(len(own)), hashlib.sha256(hashes).hexdigest()[:16]]
        seen.append([tuple(got[i]) for i, _ in rows])
    assert seen[0] == seen[1]
