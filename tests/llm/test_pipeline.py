"""The whole pipeline against plain Python, stage by stage, on made documents."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from semifold.llm import pii, quality
from tests.llm.test_neardup import plain_kept
from tests.llm.test_operators import plain_quality

COMMON = "the of and to a in is that for it with as on are this".split()


def prose(rng, n: int) -> list[str]:
    """Words with the frequent ones in their usual shares."""
    return [str(rng.choice(COMMON)) if rng.random() < 0.35 else "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(n)]


def made() -> list[tuple]:
    rng = np.random.default_rng(12)
    rows: list[tuple] = []
    for k in range(24):
        words = prose(rng, 90 + k)
        rows.append((k, " ".join(words) + ".", "en", f"s{k % 3}", 0))
        if k % 4 == 0:  # an exact copy, and one with a word changed
            rows.append((100 + k, rows[-1][1], "en", "s0", 0))
            rows.append((200 + k, " ".join([*words[:40], "changed", *words[41:]]) + ".", "en", "s1", 0))
        if k % 6 == 0:
            rows.append((300 + k, " ".join(prose(rng, 80)) + f" mail a{k}@b.org or 10.0.0.{k} now.", "en", "s2", 0))
    rows += [(400, "too short", "en", "s0", 0), (401, "again and again " * 60, "en", "s0", 0), (402, None, None, None, 0), (403, "### *** $$$ 12345 " * 30, "en", "s1", 0)]
    return rows


def test_run(spark, tmp_path):
    rows = made()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    kept = corpus_pipeline.quality_rules(spark, docs, "").collect()
    verdict = {r["doc_id"]: r["kept"] for r in quality.score(docs).collect()}
    assert {r["doc_id"] for r in kept} == {i for i, t, *_ in rows if not plain_quality(t or "")[-1] and verdict[i]}
    assert {i for i, *_ in rows if i < 400} == {r["doc_id"] for r in kept}  # clean documents stay, the four others go

    alone = plain_kept([(r["doc_id"], r["text"]) for r in kept])
    assert alone == {i for i, *_ in rows if i < 100 or 300 <= i < 400}
    texts = {r["doc_id"]: r["text"] for r in kept if r["doc_id"] in alone}
    found = pii.find_batch(list(texts.values()), pii.default_model(), pii.PiiParams())
    texts = {i: pii.masked(t, spans, "[{}]") for (i, t), (_, spans) in zip(texts.items(), found, strict=True)}
    assert sum("[EMAIL]" in t and "[IP]" in t for t in texts.values()) == 4

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    at: Counter = Counter()
    for r in pieces:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        at[r["doc_id"], r["start"]] += r["length"]
    passes = {i: sum(n for (j, _), n in at.items() if j == i) / len(ids[i]) for i in ids}
    assert set(passes.values()) <= {1.0, 2.0} and min(passes.values()) == 1  # every document once, some again
    words = Counter()
    for i, t in texts.items():
        words[rows_source(rows, i)] += len(t.split())
    again = Counter()
    for i, n in passes.items():
        again[rows_source(rows, i)] += n * len(texts[i].split())
    assert max(again[s] / words[s] for s in words) <= 1.5 + 0.15  # a document more or less
    used: dict = {}
    for r in pieces:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) == 2048 for s, p in used.items() if s != max(used))


def rows_source(rows: list[tuple], i: int):
    return next(s for j, _, _, s, _ in rows if j == i)
