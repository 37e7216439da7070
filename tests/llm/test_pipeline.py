"""The pipeline against a plain version of its five stages, on a small table and on an empty one."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from meshqa.llm import mixing, quality, toxicity
from tests.llm.test_corpus import WORD, _groups, words

DOCUMENTS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def corpus() -> list[tuple]:
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [prose(rng.randrange(30, 160)) for _ in range(150)]
    texts = [t + (" you rotten grumblewort be gone" if i % 5 == 0 else "") for i, t in enumerate(texts)]
    texts += [texts[7], texts[7], texts[8] + " end", texts[11].upper(), prose(3000), "same words here " * 40, "", None, " \n "]
    ids = rng.sample(range(10_000), len(texts))
    rows = [(i, t, "en", None if k % 11 == 0 else f"s{k % 3}", None) for k, (i, t) in enumerate(zip(ids, texts))]
    return [*rows, (None, prose(90), None, "s1", None)]


def labels(docs: list[tuple]) -> list[tuple]:
    known = [(d, int(k % 3 > 0), int("grumblewort" in (t or ""))) for k, (d, t, *_) in enumerate(docs) if d is not None and k % 4]
    return [*known, (None, 1, 1), (docs[4][0], None, None)]


def kept_by_quality(docs, labels):
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    trusted, raw, target, features = {d for d, q, _ in labels if q == 1 and d is not None}, [0] * quality.BUCKETS, [0] * quality.BUCKETS, []
    for d, t, *_ in docs:
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(t)]
        two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
        features.append([signed(x) % quality.BUCKETS for x in h + two])
        for b in features[-1]:
            raw[b] += 1
            target[b] += d in trusted
    ratio, out = quality.ratios(raw, target), []
    for row, f in zip(docs, features):
        w = words(row[1])
        many = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if many[x] > 1 for k in range(3)}
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and sum(ratio[b] for b in f) / len(f) / quality.SCALE >= quality.THRESHOLD:
            out.append(row)
    return out


def kept_by_toxicity(docs, labels):
    known = [(d, t) for d, _, t in labels if d is not None and t is not None and zlib.crc32(str(d).encode()) % 5]
    text = {d: t or "" for d, t, *_ in docs}
    there = [(text[d], t) for d, t in known if d in text]
    score = toxicity.train([t for t, _ in there], [y for _, y in there], sum(t for _, t in known) / len(known)).scorer()
    return [r for r in docs if score(r[1] or "") < 0.5]


def one_of_each_group(docs):
    def mark(text):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    marks = [mark(r[1]) for r in docs]
    root, best = _groups(marks), {}
    for r, m in zip(docs, marks):
        g = root[m]
        if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = r
    return list(best.values())


def mixed(docs):
    size, whole = {id(r): len(words(r[1])) for r in docs}, Counter()
    for r in docs:
        whole[r[3]] += size[id(r)]
    names = sorted({r[3] for r in docs} - {None}) + ([None] if any(r[3] is None for r in docs) else [])
    weight, left = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(whole.values())
    target, open_ = {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * whole[s]]
        for s in full or list(open_):
            target[s] = 2 * whole[s] if full else share[s]
            left -= target[s] if full else 0
            open_.discard(s)
    coin = lambda k, d: int(hashlib.md5(f"mix{k // 4}:{'~' if d is None else d}".encode()).hexdigest()[8 * (k % 4) : 8 * (k % 4) + 8], 16) / 2**32
    out = []
    for s in names:
        rows, rate = [r for r in docs if r[3] == s], target[s] / whole[s] if whole[s] else 0.0
        part = rate - int(rate)
        off = lambda k: abs(sum(size[id(r)] for r in rows if coin(k, r[0]) < part) - (target[s] - int(rate) * whole[s]))  # noqa: B023, E731
        seed = min(range(mixing.SEEDS), key=lambda k: (off(k), k))
        out += [r for r in rows for _ in range(int(rate) + (coin(seed, r[0]) < part))]
    return out


def encoded(docs):
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for d, t, *_ in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, docs = f"file://{tmp_path_factory.mktemp('tables')}", corpus()
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels(docs), LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_as_its_plain_version(spark, folder):
    docs = corpus()
    known = labels(docs)
    stages, rows = [lambda d: kept_by_quality(d, known), lambda d: kept_by_toxicity(d, known), one_of_each_group, mixed], docs
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), plain in zip(corpus_pipeline.STAGES, stages):
        got, rows = stage(spark, table, folder), plain(rows)
        assert got.columns == [c.split()[0] for c in DOCUMENTS.split(", ")], name
        assert Counter(map(tuple, got.collect())) == Counter(rows), name
        assert 0 < len(rows), name
        table = spark.createDataFrame(rows, DOCUMENTS)
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == encoded(rows)
    assert len({r[0] for r in rows}) < len(docs) and not any(re.search("grumblewort", r[1]) for r in rows)


def test_pipeline_of_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_stages_carry_other_columns(spark, folder):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"score": F.lit(1.0), "size": F.lit("x"), "_row": F.lit(1), "fp": F.lit(2), "kept": F.lit(False)})
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns and got.where("score = 1.0 and size = 'x' and _row = 1 and fp = 2 and not kept").count() == got.count() > 0, name
