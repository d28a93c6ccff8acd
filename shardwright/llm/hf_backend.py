"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model file is parsed here; its normaliser, blank marker, scores or merge order and byte
fallback are rebuilt as parts of that library, which encodes batches on several threads.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from shardwright.llm.common import lean, prepare_workers, table, text_of
from shardwright.llm.spm_model import BLANK, BPE, CONTROL, BYTE, NORMAL, UNKNOWN, SpmModel, load, parse

#: Where the public vocabulary files lie; a parameter of every operator that uses one.
DEFAULT_MODEL = os.environ.get("SHARDWRIGHT_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"


def merges(model: SpmModel) -> list[tuple[str, str]]:
    """Every pair of pieces that joins to a piece, best piece first; pairs of one piece by their ids."""
    ids = {piece: i for i, (piece, _, kind) in enumerate(model.pieces) if kind == NORMAL}
    found = []
    for i, (piece, score, kind) in enumerate(model.pieces):
        if kind == NORMAL:
            pairs = ((piece[:k], piece[k:]) for k in range(1, len(piece)))
            found += [(-score, i, ids[a], ids[b], a, b) for a, b in pairs if a in ids and b in ids]
    return [x[4:] for x in sorted(found)]


def normalizer(model: SpmModel) -> normalizers.Normalizer | None:
    parts: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        parts += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    blank = BLANK if model.escape_whitespaces else " "
    if model.add_dummy_prefix:
        parts.append(normalizers.Prepend(blank))
    if model.escape_whitespaces:
        parts.append(normalizers.Replace(" ", BLANK))
    return normalizers.Sequence(parts)


def build(model: SpmModel) -> Tokenizer:
    """A tokenizer of the ``tokenizers`` library that gives the model's ids.

    Control, unknown and byte pieces never match text: their scores are put below any path that
    spells their characters, or no merge leads to them.
    """
    unknown = model.pieces[model.unknown_id][0]
    if model.kind == BPE:
        vocab = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        low = 2 * model.lowest - 1000
        scored = [(p, low if kind in (CONTROL, UNKNOWN, BYTE) else score) for p, score, kind in model.pieces]
        core = models.Unigram(scored, model.unknown_id, model.byte_fallback)
    built = Tokenizer(core)
    built.normalizer = normalizer(model)
    if model.splits_at_blanks and model.escape_whitespaces:
        built.pre_tokenizer = pre_tokenizers.Split(Regex(f"{BLANK}+[^{BLANK}]*"), "isolated")
    ends = [decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []
    built.decoder = decoders.Sequence([decoders.Replace(BLANK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return built


@lru_cache(2)
def tokenizer_of(data: bytes) -> Tokenizer:
    return build(parse(data))


class WordEncoder:
    """Encodes texts by their distinct words where no piece crosses the start of a blank run.

    The tokenizer cuts there itself, so the ids of a text are those of its words in turn, and so
    is the text read back, but for the one blank that was put before it. Each distinct word is
    encoded, decoded and held against the model's own library once and remembered; most go to
    the libraries many at a time, in lines that are cut again where a piece begins with a blank.
    """

    REMEMBERED, LINE, LINES = 200_000, 1000, 16

    def __init__(self, data: bytes, verify: bool = True) -> None:
        self.model = parse(data)
        self.whole = tokenizer_of(data)
        self.reference = _reference_of(data) if verify else None
        self.by_word = self.model.splits_at_blanks and self.model.escape_whitespaces and self.model.add_dummy_prefix
        self.plain = not self.model.charsmap and not self.model.remove_extra_whitespaces
        self.word = re.compile(f"{BLANK}+[^{BLANK}]*")
        self.bare = build(self.model)  # takes words that are normalised already and gives back all blanks
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.decoder = decoders.Sequence([decoders.Replace(BLANK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.begins = np.array([piece.startswith(BLANK) for piece, _, _ in self.model.pieces])
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.words: list[str] = []
        self.odd: dict[int, str] = {}  # words that are not read back as they were
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.agrees, self.same = np.zeros(0, bool), np.zeros(0, bool)

    def _lines(self, parts: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]] | None]:
        """Per part its ids, sizes, agreement, sameness and text; None if it cannot be cut again into its words.

        Every word begins with its only blank. The parts go to the library as one batch of
        lines, which it encodes on its threads.
        """
        lines = ["".join(words) for words in parts]
        encoded = [e.ids for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)]
        decoded = self.bare.decode_batch(encoded, skip_special_tokens=False)
        expected = read = [None] * len(lines)
        if self.reference is not None:
            expected = self.reference.encode([line[1:].replace(BLANK, " ") for line in lines], num_threads=1)
            read = self.reference.decode(expected, num_threads=1)
        for words, ids, text, theirs, their_text in zip(parts, encoded, decoded, expected, read, strict=True):
            back, at = text.split(" ")[1:], np.array(ids, np.int32)
            cuts = np.flatnonzero(self.begins[at])
            whole = len(cuts) == len(words) == len(back)
            if not whole or (self.reference is not None and (theirs != ids or their_text != text[1:])):
                yield None
                continue
            same = np.array([w[1:] == b for w, b in zip(words, back, strict=True)])
            yield at, np.diff(np.append(cuts, len(at))), np.ones(len(words), bool), same, back

    def _single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """The same for any words, each by itself."""
        ids = [e.ids for e in self.bare.encode_batch_fast(words, add_special_tokens=False)]
        back = [t[1:] for t in self.bare.decode_batch(ids, skip_special_tokens=False)]
        agrees = np.ones(len(ids), bool)
        if self.reference is not None:
            # It puts the first blank itself and gives an empty text no piece, so a lone blank is held after a letter.
            plain = ["x " if w == BLANK else w[1:].replace(BLANK, " ") for w in words]
            expected = self.reference.encode(plain, num_threads=1)
            read = self.reference.decode(expected, num_threads=1)
            letter = self.reference.encode("x", num_threads=1)
            agrees = np.array([a == b[len(letter) * (w == BLANK) :] and x == y[2 * (w == BLANK) :] for w, a, b, x, y in zip(words, ids, expected, back, read, strict=True)])
        same = np.array([w[1:].replace(BLANK, " ") == b for w, b in zip(words, back, strict=True)])
        return np.array([x for own in ids for x in own], np.int32), np.array([len(x) for x in ids], np.int64), agrees, same, back

    def _learn(self, missing: list[str]) -> None:
        simple = [w for w in missing if len(w) > 1 and w[1] != BLANK]
        others = [w for w in missing if len(w) == 1 or w[1] == BLANK]
        parts = [simple[i : i + self.LINE] for i in range(0, len(simple), self.LINE)]
        found = []
        for i in range(0, len(parts), self.LINES):  # a batch of lines at a time, as encodings take far more room than ids
            batch = parts[i : i + self.LINES]
            found += [(words, line or self._single(words)) for words, line in zip(batch, self._lines(batch), strict=True)]
        found += [(others, self._single(others))] if others else []
        first = len(self.words)
        for words, (_, _, _, same, back) in found:
            self.odd.update({len(self.words) + i: back[i] for i in np.flatnonzero(~same).tolist()})
            self.words += words
        self.number.update(zip(self.words[first:], range(first, len(self.words)), strict=True))
        flat, size, agrees, same = (np.concatenate([x[k] for _, x in found]) for k in range(4))
        self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
        self.size, self.flat = np.append(self.size, size), np.append(self.flat, flat)
        self.agrees, self.same = np.append(self.agrees, agrees), np.append(self.same, same)

    def normalize(self, text: str) -> str:
        if not self.plain:
            return self.whole.normalizer.normalize_str(text)
        return BLANK + text.replace(" ", BLANK) if text else text

    def _numbers(self, words: list[str]) -> list[int]:
        missing = [w for w in dict.fromkeys(words) if w not in self.number]
        if missing:
            self._learn(missing)
        return list(map(self.number.__getitem__, words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], list[bool | None]]:
        """All ids in turn, the number of each text's ids, the texts read back, and whether the model's library agrees."""
        if not self.by_word:
            return self._encode_whole(texts)
        if len(self.words) > self.REMEMBERED:
            self.forget()
        # Texts whose blanks stand alone are cut into words, and words into distinct ones, as columns.
        easy = [bool(self.plain and t and t[0] != " " and "  " not in t and BLANK not in t) for t in texts]
        codes: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        chosen = [i for i, ok in enumerate(easy) if ok]
        if chosen:
            lists = pc.split_pattern(pa.array([texts[i] for i in chosen], pa.large_string()), " ")
            ends = lists.offsets.to_numpy()
            coded = lists.values.dictionary_encode()
            number = np.array(self._numbers([BLANK + w for w in coded.dictionary.to_pylist()]), np.int64)
            every = number[coded.indices.to_numpy()]
            for k, i in enumerate(chosen):
                codes[i] = every[ends[k] : ends[k + 1]]
        for i, ok in enumerate(easy):
            if not ok and texts[i]:
                codes[i] = np.array(self._numbers(self.word.findall(self.normalize(texts[i]))), np.int64)
        at = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        size = self.size[at]
        ends = np.cumsum(size)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - ends + size, size)]
        sizes = np.array([self.size[own].sum() for own in codes], np.int64)
        back, parity = [], []
        for text, own in zip(texts, codes, strict=True):
            whole = self.plain and BLANK not in text and self.same[own].all()
            back.append(text if whole else "".join([" " + self.odd.get(k, self.words[k][1:].replace(BLANK, " ")) for k in own.tolist()])[1:])
            parity.append(bool(self.agrees[own].all()) if self.reference is not None else None)
        return flat, sizes, back, parity

    def _encode_whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], list[bool | None]]:
        ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        back = self.whole.decode_batch(ids, skip_special_tokens=False)
        parity: list[bool | None] = [None] * len(ids)
        if self.reference is not None:
            expected = self.reference.encode(texts, num_threads=1)
            read = self.reference.decode(expected, num_threads=1)
            parity = [a == b and x == y for a, b, x, y in zip(ids, expected, back, read, strict=True)]
        flat = np.concatenate([np.zeros(0, np.int32), *[np.array(x, np.int32) for x in ids]])
        return flat, np.array([len(x) for x in ids], np.int64), back, parity


@lru_cache(2)
def word_encoder_of(data: bytes, verify: bool) -> WordEncoder:
    return WordEncoder(data, verify)


@lru_cache(2)
def _reference_of(data: bytes):
    """The library the model comes from, against which parity is verified."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=data)


def _groups(texts: list[str], chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_documents(docs: DataFrame, model: bytes, threads: int = 2, verify: bool = True) -> DataFrame:
    """``doc_id, n_chars, n_tokens, ids, decoded_sha256, round_trip, parity`` of every whole text.

    ``ids`` are the piece ids; ``decoded_sha256`` is the digest of the text read back from them,
    ``round_trip`` tells whether that is the text itself (a model may normalise), ``parity``
    whether the model's own library gives the same ids and the same text back, held word by
    word where the text was encoded so (null without ``verify``). A null text is empty and has no ids. Rows that repeat are encoded each. An
    empty table gives an empty result; other columns are ignored. Each worker encodes on
    ``threads`` threads.
    """
    prepare_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_chars long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean, parity boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        ours = word_encoder_of(shared.value, verify)
        for batch in batches:
            keys, all_texts = batch.column(0).cast(pa.int64()), batch.column(1).to_pylist()
            for begin, end in _groups(all_texts):
                texts = all_texts[begin:end]
                flat, sizes, back, parity = ours.encode(texts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": keys.slice(begin, end - begin),
                        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                        "n_tokens": pa.array(sizes, pa.int64()),
                        "ids": pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(flat)),
                        "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                        "round_trip": pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                        "parity": pa.array(parity, pa.bool_()),
                    }
                )
        ours.forget()  # a worker lives on after its task

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(lean(work), schema)


def decode_documents(encoded: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, text`` read back from ``doc_id, ids``; null or empty ids give the empty text."""
    prepare_workers(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = tokenizer_of(shared.value)
        for batch in batches:
            back = ours.decode_batch([x or [] for x in batch.column(1).to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "text": pa.array(back, pa.string())})

    return encoded.select("doc_id", F.col("ids").alias("ids")).mapInArrow(lean(work), "doc_id long, text string")


def op7_sentencepiece(spark, sf_dir: str, model_path: str = DEFAULT_MODEL) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), load(model_path))
