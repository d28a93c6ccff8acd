"""Chat formatting, token counts and SentencePiece encoding."""

from __future__ import annotations

import dataclasses
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shardwright.llm.chat import escape, prefix_examples, read_back, read_turns, unescape
from shardwright.llm.hf_backend import DEFAULT_MODEL, build, decode_documents, encode_documents, tokenizer_of
from shardwright.llm.spm_model import UNIGRAM, load, parse
from shardwright.llm.unigram_count import Automaton, count_tokens

needs_model = pytest.mark.skipif(not Path(DEFAULT_MODEL).exists(), reason="no vocabulary file here")

CHAT = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "hi <|im_end|>"),
    (1, 2, "assistant", "<|im_start|>assistant\nok<\\|x <\\\\| <|"),
    (1, 3, "user", None),
    (1, 4, "assistant", "é🙂"),
    (1, 5, "user", "bye"),
    (2, 0, "user", "no answer"),
    (3, 1, "assistant", ""),
    (4, None, None, "first"),
    (4, 0, "a\\b\nc", "<||>"),
    (5, 0, "assistant", "tie b"),
    (5, 0, "assistant", "tie a"),
    (6, 0, "assistant", "word " * 20000),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_examples_read_back(spark):
    turns = spark.createDataFrame(CHAT, SCHEMA).withColumn("example", F.lit("clash"))
    examples = prefix_examples(turns)
    assert Counter_of(examples) == {1: 3, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1}
    got = {r["conv_id"]: r for r in read_back(examples).collect()}
    for conv in range(1, 7):
        own = sorted((t if t is not None else -1, r or "", x or "") for c, t, r, x in CHAT if c == conv)
        text = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def Counter_of(examples):
    return {r["conv_id"]: r["count"] for r in examples.groupBy("conv_id").count().collect()}


def test_each_example_trains_one_reply(spark):
    rows = prefix_examples(spark.createDataFrame(CHAT[:6], SCHEMA)).orderBy("example").collect()
    spans = [r["text"][r["loss_start"] : r["loss_end"]] for r in rows]
    assert spans[1:] == ["é🙂", ""] and "<|im_" not in spans[0]
    assert rows[1]["text"].startswith(rows[0]["text"])
    assert prefix_examples(spark.createDataFrame([], SCHEMA)).count() == 0


def test_escaping_is_reversible(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice("<|\\x\n") for _ in range(12)) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] and "<|" not in r["e"] for r in got)
    assert read_turns is not None


PROBES = ["", " ", "a", "  a", "a  b", "a ", "\n\t", "<s> <unk> <0x41>", "▁▁ a", "日本語", "🙂 é", "x" * 300, "a\u0000b", " " * 40]


def probes():
    rng = random.Random(1)
    return PROBES + ["".join(rng.choice("ab the \n▁é日🙂<>s0x") for _ in range(rng.randint(0, 30))) for _ in range(400)]


@needs_model
def test_backend_has_parity_with_the_library():
    from sentencepiece import SentencePieceProcessor

    data = load(DEFAULT_MODEL)
    ours, theirs = tokenizer_of(data), SentencePieceProcessor(model_proto=data)
    for text in probes():
        ids = ours.encode(text, add_special_tokens=False).ids
        assert ids == theirs.encode(text)
        assert ours.decode(ids, skip_special_tokens=False) == theirs.decode(ids)


@needs_model
def test_encoding_documents(spark, awkward, nothing):
    from sentencepiece import SentencePieceProcessor

    data = load(DEFAULT_MODEL)
    theirs = SentencePieceProcessor(model_proto=data)
    encoded = encode_documents(awkward, data)
    texts = {r["doc_id"]: r["text"] or "" for r in awkward.collect()}
    for r in encoded.collect():
        assert r["ids"] == theirs.encode(texts[r["doc_id"]]) and r["parity"]
        assert r["round_trip"] == (theirs.decode(r["ids"]) == texts[r["doc_id"]])
        assert r["n_tokens"] == len(r["ids"]) and r["n_chars"] == len(texts[r["doc_id"]])
    back = {r["doc_id"]: r["text"] for r in decode_documents(encoded, data).collect()}
    assert back == texts
    assert encode_documents(nothing, data).count() == 0
    many = spark.createDataFrame([(i, t) for i, t in enumerate(probes())], "doc_id long, text string")
    assert encode_documents(many, data).where("NOT parity").count() == 0


@needs_model
def test_counts_are_those_of_the_unigram_tokenizer(spark, awkward, nothing):
    data = load(DEFAULT_MODEL)
    model = parse(data)
    reference = build(dataclasses.replace(model, kind=UNIGRAM))
    automaton = Automaton(model)
    texts = probes()
    assert [n for n, _ in automaton.count(texts)] == [len(reference.encode(t, add_special_tokens=False).ids) for t in texts]
    assert count_tokens(awkward, data).count() == awkward.count() and count_tokens(nothing, data).count() == 0
    assert count_tokens(awkward.where("doc_id < 3"), data).where("n_tokens = 0").count() == 2


def brute_force(model, text):
    """Best path by trying every start for every end, the earliest start first."""
    pieces = {p: s for p, s, kind in model.pieces if kind == 1}
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            score = pieces.get(piece, model.lowest - 10 if end - start == 1 else None)
            if score is not None and (best[end] is None or best[start][0] + score > best[end][0]):
                n = 1 if piece in pieces or not model.byte_fallback else len(piece.encode())
                best[end] = (best[start][0] + score, best[start][1] + n)
    return best[len(text)]


def test_automaton_is_brute_force_with_ties():
    from shardwright.llm.spm_model import SpmModel

    rng = random.Random(2)
    for _ in range(60):
        pieces = {"".join(rng.choice("ab▁é") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        pieces = [p for p in pieces if "▁" not in p.lstrip("▁")] + ["▁"]
        model = SpmModel([("<unk>", 0.0, 2), *[(p, float(-rng.randint(1, 4)), 1) for p in dict.fromkeys(pieces)]], byte_fallback=True, remove_extra_whitespaces=False)
        automaton = Automaton(model)
        texts = ["".join(rng.choice("abé x") for _ in range(rng.randint(1, 14))) for _ in range(20)]
        for text, got in zip(texts, automaton.count(texts)):
            expected = brute_force(model, "▁" + text.replace(" ", "▁"))
            assert got == (expected[1], expected[0])
