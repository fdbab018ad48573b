"""The pipeline's stages against brute force, each on what the one before kept."""

import hashlib
import math
import os

import public_tokenizers
import sentencepiece

import corpus_pipeline
from palisade.llm import common, language_id
from tests.conftest import DATA
from tests.llm.test_operators import brute_components, brute_repeats, documents, frame, odd_texts


def test_stages(spark):
    docs = common.table(spark, DATA, "documents")
    texts, kept = documents(docs), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, DATA), name)
        kept[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    after = {name: {r["doc_id"]: r["text"] for r in rows} for name, rows in kept.items() if name != "sentencepiece"}
    assert after["language_id"] == {d: t for d, t in texts.items() if any(map(str.isalpha, t))}
    linked = brute_components(after["language_id"], 5, 80)
    assert after["ngram_join"] == {d: t for d, t in after["language_id"].items() if linked[d][1] == d}
    removed = brute_repeats(after["ngram_join"], 100)
    for doc, text in after["suffix_dedup"].items():
        assert len(text.encode()) <= removed[doc][0] - removed[doc][1]
        if removed[doc][1] == 0:
            assert text == after["ngram_join"][doc]
    assert set(after["suffix_dedup"]) == {d for d, r in removed.items() if r[1] < r[0]}
    assert after["mixing"] == after["suffix_dedup"] and len(kept["mixing"]) >= len(after["mixing"])
    assert all(r["n_chars"] == len(r["text"]) for r in kept["mixing"])
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert len(kept["sentencepiece"]) == len(kept["mixing"])
    for r in kept["sentencepiece"]:
        assert r["ids"] == model.encode(after["mixing"][r["doc_id"]], add_eos=True)
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(r["ids"]).encode()).hexdigest()


def test_mixed_languages_are_kept(spark):
    docs = common.table(spark, DATA, "documents").select(*corpus_pipeline.COLUMNS)
    words = {}
    for r in docs.filter("lang is not null").orderBy("doc_id").collect():
        words.setdefault(r["lang"], []).extend(r["text"].split())
    langs = sorted(words)
    assert len(langs) >= 4
    texts = []
    for n in (3, 4):
        for first in range(len(langs)):
            chosen = [langs[(first + i) % len(langs)] for i in range(n)]
            texts.append("\n".join(" ".join(words[x][k * 12 : k * 12 + 12]) for k in range(4) for x in chosen))
    mixed = spark.createDataFrame([(10**9 + i, t, None, "mixed", len(t)) for i, t in enumerate(texts)], docs.schema)
    scores = [r["score"] for r in language_id.identify(mixed, language_id.train(docs)).collect()]
    assert sum(s < corpus_pipeline.LEAST_SCORE for s in scores) >= len(langs)
    kept = {r["doc_id"] for r in corpus_pipeline.keep_languages(spark, docs.unionByName(mixed), DATA).collect()}
    assert {10**9 + i for i in range(len(texts))} <= kept


def test_odd_rows_and_empty_table(spark):
    docs = frame(spark, odd_texts())
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, DATA), name)
    assert docs.count() > 10
    docs = frame(spark, odd_texts()).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, DATA), name)
    assert docs.count() == 0


def test_rows_without_id_lose_only_their_own_bytes(spark):
    """Different texts without id, through the third stage and the whole run."""
    docs = common.table(spark, DATA, "documents").select(*corpus_pipeline.COLUMNS)
    long = [r["text"] for r in docs.filter("n_chars between 600 and 3000 and lang is not null").orderBy("doc_id").limit(4).collect()]
    long = [" ".join(f"{w}{i}" for w in t.split()) for i, t in enumerate(long)]
    texts = [long[0], long[1], long[2] + " " + long[0][:300], long[3]]
    rows = [(None, t, "en", "s", len(t)) for t in texts] + [(7, "x " + long[1], "en", "s", len(long[1]) + 2)]
    df = spark.createDataFrame(rows, docs.schema)
    out = corpus_pipeline.drop_repeated_strings(spark, df, DATA).collect()
    left = {r["text"] for r in out if r["doc_id"] is None}
    assert long[1] in left and long[3] in left  # they repeat nothing that stands before them
    assert sum(len(t) for t in left) in range(sum(map(len, texts)) - 301, sum(map(len, texts)) - 198)
    assert all(r["text"] in ("x", "x ") for r in out if r["doc_id"] == 7)


def test_small_sources_are_mixed_in(spark):
    """Sources of unlike sizes come out as even as four passes allow, and one of a single word doesn't keep them from it."""
    docs = {"big": 60, "middle": 18, None: 1} | {f"small{k}": 6 for k in range(5)}
    rows = [(1000 * i + k, " ".join(f"w{i}x{k}y{j}" for j in range(20 if s else 1)), "en", s, 0) for i, (s, n) in enumerate(docs.items()) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mix_sources(spark, df, DATA).collect()
    assert {(r["doc_id"], r["text"], r["source"]) for r in out} == {(d, t, s) for d, t, _, s, _ in rows}
    words = {s: sum(len(r["text"].split()) for r in out if r["source"] == s) for s in docs}
    assert {words[s] for s in docs if s and s.startswith("small")} == {4 * 6 * 20} and words["big"] == 60 * 20 and words[None] == 4
    # the exponent that takes the small sources four times
    alpha = 1 - math.log(4) / math.log(60 / 6)
    assert 0 <= words["middle"] - 60 * 20 * (18 / 60) ** alpha < 20
    assert (words["big"] + words["middle"]) / sum(words.values()) < 0.45 < 0.7 < (60 + 18) / sum(docs.values())


def test_run_leaves_one_table_of_stages(spark):
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, DATA).count() > 10
    left = [name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before]
    assert [x for x in left if x in dict(corpus_pipeline.STAGES)] == ["mixing"]
    assert not {"signatures", "runs", "repeats", "links"} & set(left)
