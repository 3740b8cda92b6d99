"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here, field by field, and an equal tokenizer is
rebuilt: normaliser (character map, white-space rules, dummy prefix), metaspace
marker, unigram scores or pair merges in score order, byte fallback, decoder.
Batches are encoded by several threads; the ids returned are the rebuilt tokenizer's. Every
text (or, where no piece goes beyond a word, every distinct word) also goes to the
sentencepiece library; where the two differ (pieces of equal score can be merged in
another order) the library's ids are taken, and the row says so. The rebuilt decoder
must give the text back, word by word or as a whole.

Defined results: a null text is encoded as an empty one (no ids, decoded to empty);
each row is encoded by itself, so null ids, repeated rows and ties need no care; an
empty table gives no rows; further columns are passed on by ``encode`` unless they
bear the name of a column that it makes. Strings such as ``<s>`` in a text are text.
A U+2581 in a text is decoded as a space, as the model cannot tell them apart.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import KEPT, modest, table, trimmed

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters that are encoded in one call: bounds a worker's memory whatever the batch.
CHUNK_CHARS = 400_000
THREADS = 2
#: Words and bytes of words whose ids a worker keeps (about 200 bytes a word besides), and words that are encoded in one call.
KEPT_WORDS, KEPT_BYTES, CHUNK_WORDS = 400_000, 16_000_000, 10_000
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message: number and value (varint, 4 or 8 raw bytes, or a length's bytes)."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} in a model file")
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> dict:
    """pieces [(piece, score, type)], kind, byte_fallback, unk_id and the normaliser's settings."""
    out = {"pieces": [], "kind": UNIGRAM, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True, "suffix": False}
    for field, value in wire(data):
        if field == 1:
            piece, score, kind = "", 0.0, NORMAL
            for f, v in wire(value):
                if f == 1:
                    piece = v.decode()
                elif f == 2:
                    score = struct.unpack("<f", v)[0]
                elif f == 3:
                    kind = v
            out["pieces"].append((piece, score, kind))
        elif field == 2:
            for f, v in wire(value):
                if f == 3:
                    out["kind"] = v
                elif f == 35:
                    out["byte_fallback"] = bool(v)
                elif f == 24:
                    out["suffix"] = bool(v)
        elif field == 3:
            for f, v in wire(value):
                if f == 2:
                    out["charsmap"] = v
                elif f == 3:
                    out["dummy_prefix"] = bool(v)
                elif f == 4:
                    out["squeeze"] = bool(v)
                elif f == 5:
                    out["escape"] = bool(v)
    out["unk_id"] = next(i for i, p in enumerate(out["pieces"]) if p[2] == UNKNOWN)
    if out["kind"] not in (UNIGRAM, BPE) or out["suffix"] or not out["escape"]:
        raise ValueError("only unigram and BPE models with an escaped, leading white-space marker can be rebuilt")
    return out


def words_are_apart(model: dict) -> bool:
    """No piece goes on from a word into the marker of the next, so words can be encoded one by one."""
    return not any(MARK in p.lstrip(MARK) for p, _, kind in model["pieces"] if kind in (NORMAL, USER))


def rebuild(model: dict):
    """The tokenizers object that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    pieces = model["pieces"]
    ids = {p: i for i, (p, _, _) in enumerate(pieces)}
    if model["kind"] == BPE:
        own = {p: (-s, i) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        ranked = sorted((own[p], at, p) for p in own for at in range(1, len(p)) if p[:at] in own and p[at:] in own)
        core = models.BPE(vocab=ids, merges=[(p[:at], p[at:]) for _, at, p in ranked], unk_token=pieces[model["unk_id"]][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        core = models.Unigram([(p, s if kind in (NORMAL, USER, BYTE) else -1e9) for p, s, kind in pieces], model["unk_id"], model["byte_fallback"])
    tok = Tokenizer(core)
    steps = []
    if model["charsmap"]:
        steps.append(normalizers.Precompiled(model["charsmap"]))
    if model["squeeze"]:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    steps.append(normalizers.Replace(" ", MARK))
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    tok.normalizer = normalizers.Sequence(steps)
    if words_are_apart(model):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else [])])
    return tok


class Codec:
    """Both libraries' encoders of one model; one a worker.

    Where no piece goes on from a word into the next, a text's ids are its words' ids in
    a row, in either library. Then each distinct word is encoded, compared and kept, and
    texts are put together from the kept ids; otherwise whole texts go to both libraries.
    """

    kept: dict[str, Codec] = {}

    def __init__(self, data: bytes, threads: int = THREADS):
        import sentencepiece

        # The thread pool of the tokenizers library reads these when it is first used.
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        model = parse_model(data)
        self.tok, self.threads = rebuild(model), threads
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.marked = np.array([p.startswith(MARK) for p, _, _ in model["pieces"]])
        self.bytes = np.array([kind == BYTE for _, _, kind in model["pieces"]])
        # A line feed that is in no piece but its own parts words as well.
        inside = any("\n" in p and len(p) > 1 for p, _, kind in model["pieces"] if kind in (NORMAL, USER))
        self.by_word = words_are_apart(model) and model["dummy_prefix"] and not model["squeeze"] and not model["charsmap"] and not inside
        self.words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.forget()

    @classmethod
    def of(cls, data: bytes) -> Codec:
        key = hashlib.sha256(data).hexdigest()
        if key not in cls.kept:
            cls.kept.clear()
            cls.kept[key] = cls(data)
        KEPT["codec"] = cls.kept.clear
        return cls.kept[key]

    def forget(self) -> None:
        """ids of the words; those that the libraries encode differently; those that are not decoded to themselves; bytes of the words."""
        self.ids: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.lossy: set[str] = set()
        self.size = 0

    def _learn(self, words: list[str]) -> None:
        """Encode words by both libraries, decode them again and keep the ids; those that differ are odd.

        A word is sent as a text that keeps it apart. Either library sets a marker before
        a text: the word's own first one, or one that a line feed keeps off the word. The
        line feed is an id of its own; what was added is cut from the ids.
        """
        simple = [w for w in words if len(w) > 1 and w[0] == MARK != w[1]]
        rest = [w for w in words if not (len(w) > 1 and w[0] == MARK != w[1])]
        for k in range(0, len(simple), CHUNK_WORDS):
            if not self._learn_in_a_row(simple[k : k + CHUNK_WORDS]):
                rest += simple[k : k + CHUNK_WORDS]
        for k in range(0, len(rest), CHUNK_WORDS):
            some = rest[k : k + CHUNK_WORDS]
            asked = [w[1:].replace(MARK, " ") + "\n" if w[0] == MARK else "\n" + w for w in some]
            got = [e.ids for e in self.tok.encode_batch_fast(asked, add_special_tokens=False)]
            want = self.model.encode(asked, num_threads=self.threads)
            taken = [a if a == b else b for a, b in zip(got, want, strict=True)]
            self.odd.update(w for w, a, b in zip(some, got, want, strict=True) if a != b)
            self.lossy.update(w for w, a, b in zip(some, asked, self.decode(taken), strict=True) if a != b)
            self.ids.update((w, struct.pack(f"<{len(x) - 1 if w[0] == MARK else len(x) - 2}i", *(x[:-1] if w[0] == MARK else x[2:]))) for w, x in zip(some, taken, strict=True))
            self.size += sum(map(len, some))

    def _learn_in_a_row(self, words: list[str]) -> bool:
        """Words with one marker, before them, as one text of both libraries; each begins at a piece with a marker. Nothing is kept if the ids differ, or do not give the text back."""
        text = " ".join(w[1:] for w in words)
        ids = self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids
        flat = np.asarray(ids, "<i4")
        begin = np.flatnonzero(self.marked[flat])
        if ids != self.model.encode(text) or len(begin) != len(words) or begin[0] or self.tok.decode(ids, skip_special_tokens=False) != text:
            return False
        raw, at = flat.tobytes(), [*(4 * begin).tolist(), 4 * len(flat)]
        self.ids.update(zip(words, (raw[a:b] for a, b in zip(at, at[1:], strict=False)), strict=True))
        self.size += len(text)
        return True

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """ids of each text, whether the rebuilt tokenizer gave the library's own ids, and whether they decode to the text."""
        if not self.by_word:
            ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            want = self.model.encode(texts, num_threads=self.threads)
            same = [a == b for a, b in zip(ids, want, strict=True)]
            taken = [a if x else b for a, b, x in zip(ids, want, same, strict=True)]
            return [np.asarray(x, "<i4") for x in taken], same, [x == y for x, y in zip(self.decode(taken), texts, strict=True)]
        parts = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.ids) > KEPT_WORDS or self.size > KEPT_BYTES:
            self.forget()
        if new := set().union(*parts).difference(self.ids):
            self._learn(sorted(new))
        ids = [np.frombuffer(b"".join(map(self.ids.__getitem__, p)), "<i4") for p in parts]
        same = [not self.odd or self.odd.isdisjoint(p) for p in parts]
        # A marker in a text was taken for a space before the words were cut.
        return ids, same, [MARK not in t and (not self.lossy or self.lossy.isdisjoint(p)) for t, p in zip(texts, parts, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many characters, or one text."""
    start = n = 0
    for i, t in enumerate(texts):
        if i > start and n + len(t) > most:
            yield start, i
            start, n = i, 0
        n += len(t)
    if texts:
        yield start, len(texts)


def encode(df: DataFrame, text_col: str = "text", model_path: str = MODEL_PATH, with_text: bool = True) -> DataFrame:
    """df with ids (array<int>), n_tokens, n_byte_tokens, ids_sha256, parity, round_trip.

    round_trip: the ids decode to the text. with_text=False leaves the text and ids out.
    A map over the rows: no shuffle, and a lost executor costs its own tasks only.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    made = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_byte_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("parity", T.BooleanType()), T.StructField("round_trip", T.BooleanType())])
    if with_text:
        made.add("ids", T.ArrayType(T.IntegerType()))
    carried = [f for f in df.schema if f.name not in made.names and (with_text or f.name != text_col)]
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(data)
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            for a, b in chunks(texts):
                own = texts[a:b]
                ids, same, back = codec.encode(own)
                cols = {
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "n_byte_tokens": pa.array([int(codec.bytes[x].sum()) for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    "parity": pa.array(same, pa.bool_()),
                    "round_trip": pa.array(back, pa.bool_()),
                }
                if with_text:
                    ends = np.cumsum([0, *map(len, ids)], dtype="<i4")
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                kept = [batch.column(batch.schema.get_field_index(n)).slice(a, b - a) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, *cols.values()], [*names, *cols])

    modest(df.sparkSession)
    src = df.select(*dict.fromkeys([*(f"`{n}`" for n in names), f"`{text_col}`"]))
    return src.mapInArrow(trimmed(run, "codec"), T.StructType([*carried, *made]))


def decode(df: DataFrame, ids_col: str = "ids", model_path: str = MODEL_PATH, out_col: str = "decoded") -> DataFrame:
    """df with the text of each row's ids (null: null)."""
    with open(model_path, "rb") as f:
        data = f.read()
    names = [f.name for f in df.schema if f.name != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(data)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            texts = codec.decode([x or [] for x in ids])
            made = pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), made], [*names, out_col])

    modest(df.sparkSession)
    return df.select(*(f"`{n}`" for n in names)).mapInArrow(trimmed(run, "codec"), T.StructType([f for f in df.schema if f.name != out_col]).add(out_col, T.StringType()))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, with_text=False)
