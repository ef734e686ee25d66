"""The pipeline: every stage against a version written from its definition, on what the stage before kept."""

import hashlib
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from kvloom.llm import bpe, lang_id, ngram_join, secrets

from .data import empty, frame, texts
from .test_operators import groups, shingles, targets

TEXTS = texts()


def by_hand_language(text, field):
    """Letters, evidence and shares of one text, word by word, with forward-backward in plain numbers."""
    words, k = [], len(field.labels)
    chains = [[w for w in re.findall(r"[^\W\d_]+", part)] for part in re.split(r"[.!?\n]", text or "")]
    sums = [0.0] * k
    for chain in filter(None, chains):
        words += chain
        scores = np.exp(field.scores([w.lower() for w in chain]).astype(np.float64))
        step, ahead = np.exp(field.moves), [np.exp(field.starts) * scores[0]]
        for s in scores[1:]:
            now = (ahead[-1] / ahead[-1].sum()) @ step * s
            ahead.append(now)
        back = np.ones(k)
        for t in range(len(chain) - 1, -1, -1):
            p = ahead[t] * back
            sums = sums + p / p.sum()
            back = step @ (scores[t] * back)
            back /= back.sum()
    letters = sum(map(len, words))
    if not letters:
        return False
    known = sum(len(w) for w in words if all(("^" + w.lower() + "$")[i : i + 3] in field.evidence.known for i in range(len(w))))
    best = int(np.argmax(sums))
    return max(sums) >= 0.3 * sum(sums) and (letters < 20 or known >= field.evidence.least[field.labels[best]] * letters)


def test_stages_are_brute_force(spark, tmp_path):
    """Languages by hand, near copies by all pairs, secrets cut out of the text, the mix by its targets, tokens by the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in enumerate(TEXTS)]
    rows += [(500, 'the key password="Abcdef123456" is in here'), (501, "qzx wvk " * 30), (None, "one two three four five six"), (502, rows[0][1] + " tail"), (502, "another text of this very id")]
    docs = frame(spark, rows)
    field = lang_id.fit(docs)
    named = lambda df: sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=repr)
    now, want = corpus_pipeline.language(spark, docs, str(tmp_path)), [r for r in named(docs) if by_hand_language(r[1], field)]
    assert named(now) == want and len(want) < len(rows)

    docs = spark.createDataFrame(now.collect(), docs.schema)
    sets = [shingles(t) for _, t, _ in want]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and want[a][0] is not None and want[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = groups(links, range(len(sets)))
    least = {}
    for i, (doc_id, _, _) in enumerate(want):
        least[root[i]] = min(least.get(root[i], doc_id), doc_id) if doc_id is not None else None
    now = corpus_pipeline.near_copies(spark, docs, str(tmp_path))
    assert Counter(r[0] for r in named(now)) == Counter(least.values())

    docs, want = spark.createDataFrame(now.collect(), docs.schema), named(now)
    enc = secrets.encoding(public_tokenizers.path(secrets.VOCABULARY))
    clean = []
    for doc_id, text, source in want:
        base = secrets.base_spans(text)
        spans = sorted(base + secrets.random_spans(text, base, enc), key=lambda s: (s[0], secrets.KINDS.index(s[2])))
        hidden = [any(a <= i < b for a, b, _ in spans) for i in range(len(text))]
        clean.append((doc_id, "".join(c for c, h in zip(text, hidden) if not h), source))
    now = corpus_pipeline.mask_secrets(spark, docs, str(tmp_path))
    bare = sorted([(i, re.sub(r"\[(assign|access|hex|random)\]", "", t), s) for i, t, s in named(now)], key=repr)
    assert bare == sorted(clean, key=repr) and any("password" in t for _, t, _ in want) and not any("Abcdef123456" in t for _, t, _ in bare)

    docs, want = spark.createDataFrame(now.collect(), docs.schema), named(now)
    sizes, most = Counter(), Counter()
    for _, t, s in want:
        sizes[s] += len(t.encode().split())
        most[s] = max(most[s], len(t.encode().split()))
    now = corpus_pipeline.mixture(spark, docs, str(tmp_path))
    taken = Counter()
    for _, t, s in named(now):
        taken[s] += len(t.encode().split())
    assert all(abs(taken[s] - w) <= most[s] for s, w in targets(dict(sizes)).items())
    assert set(named(now)) <= set(want) and max(Counter(named(now)).values()) <= 2

    docs, want = spark.createDataFrame(now.collect(), docs.schema), named(now)
    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    ids = [(i, t.encode(x, add_special_tokens=False).ids) for i, x, _ in want]
    told = sorted(((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids), key=repr)
    assert sorted(map(tuple, corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect()), key=repr) == told


def test_stages_by_hand(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "secrets", "mixture", "tokens"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        if name == "language":
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect() if not any(map(str.isalpha, r.text or ""))}
        if name == "near_copies":
            parts = ngram_join.jaccard_components(docs)
            assert sorted(r.doc_id for r in after.collect()) == sorted(r.component_id for r in parts.select("component_id").distinct().collect())
        after.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    want = sorted(tuple(r) for r in bpe.encode_digests(docs).collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_empty_documents(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
