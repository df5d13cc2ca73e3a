"""Byte-pair encoding by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton whose arcs carry tokens and whose
paths from the start are exactly the token sequences that the merges produce.  It begins as one
state with a loop for every base symbol.  The gadget of merge (u, v -> w) splits the state that u
leads to: the new state copies its arcs but the one of v, and every state with an arc u gains an
arc w to where v leads.  All arcs of one token lead to one state, so the automaton is a few arrays:
the state of each token, and of each state the one it was copied from, the arc taken away and the
merge that made it.  Whether a state has an arc is read by walking these arrays.

A pre-split word is encoded by table-driven transitions: from the current state the longest token
that continues the word and has an arc is taken, stepping back where no arc leads on (a position is
tried once, as every prefix has one path).  Decoding emits the labels of the arcs.

Normalising and pre-splitting follow the tokenizer's file: NFC, white space to one space, lower
case, then the file's pattern; special tokens in a text stay whole.  Words recur, so each Python
worker keeps a bounded table of encoded words.  Null counts as empty; empty and white texts have no
tokens.  Whole texts are read, long ones in one piece; extra columns are carried along.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from gridloom.llm.common import to_workers

#: Words that a worker remembers at most before it starts anew.
REMEMBERED = 200_000
#: State and token pairs whose arc a worker remembers at most.
ARCS = 200_000
END = "</w>"


def byte_labels() -> list[str]:
    """The printable character of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Automaton:
    """Tokenization automaton of one vocabulary and its merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        n = max(vocab.values()) + 1
        self.labels = [""] * n
        for t, i in vocab.items():
            self.labels[i] = t
        self.left, self.rank, self.state = [-1] * n, [-1] * n, [0] * n
        self.parent, self.removed, self.born = [0], [-1], [-1]
        self.known: dict[int, bool] = {}
        alphabet = byte_labels()
        live = {vocab[s] for c in alphabet for s in (c, c + END) if s in vocab}
        for i, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u in live and v in live and w not in live and self.arc(self.state[u], v):
                self._gadget(i, u, v, w)
                live.add(w)
        self.trie: dict = {}
        for t in live:
            label = self.labels[t]
            end = label.endswith(END) and len(label) > len(END)
            node = self.trie
            for c in label[: -len(END)] if end else label:
                node = node.setdefault(c, {})
            node[END if end else ""] = t

    def _gadget(self, i: int, u: int, v: int, w: int) -> None:
        self.left[w], self.rank[w], self.state[w] = u, i, self.state[v]
        self.parent.append(self.state[u])
        self.removed.append(v)
        self.born.append(i)
        self.state[u] = len(self.parent) - 1

    def arc(self, p: int, t: int) -> bool:
        """Whether state ``p`` has an arc of token ``t``."""
        while p:
            if self.rank[t] >= self.born[p]:
                t = self.left[t]
            elif t == self.removed[p]:
                return False
            else:
                p = self.parent[p]
        return True

    def encode(self, word: str) -> list[int]:
        """Tokens of one pre-split word given in byte labels."""
        n, state, known, path, p, i = len(word), self.state, self.known, [], 0, 0
        back: list[tuple[int, list[tuple[int, int]]]] = []  # per token taken: where it began, shorter choices left
        tried = set()
        steps = None
        while i < n:
            if steps is None:
                steps, node, j = [], self.trie, i
                while j < n:
                    node = node.get(word[j])
                    if node is None:
                        break
                    j += 1
                    t = node.get("" if j < n else END)
                    if t is not None:
                        steps.append((j, t))
            while steps:
                j, t = steps.pop()
                if j in tried:
                    continue
                key = p << 20 | t
                ok = known.get(key)
                if ok is None:
                    ok = known[key] = self.arc(p, t)
                if ok:
                    path.append(t)
                    back.append((i, steps))
                    tried.add(j)
                    p, i, steps = state[t], j, None
                    break
            else:
                if not back:
                    raise ValueError("the vocabulary does not cover this word")
                path.pop()
                i, steps = back.pop()
                p = state[path[-1]] if path else 0
        if len(known) > ARCS:
            known.clear()
        return path


class Tokenizer:
    """Encoder and decoder of one tokenizer file, with its own table of words."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model, split = d["model"], d["pre_tokenizer"]["pretokenizers"][0]
        kinds = [x["type"] for x in d["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or d["decoder"] is not None:
            raise ValueError("not a lower-casing word-end BPE tokenizer")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.auto = Automaton(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.labels = self.auto.labels + [""] * (max([0, *self.special.values()]) + 1 - len(self.auto.labels))
        for t, i in self.special.items():
            self.labels[i] = t
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.bytes = byte_labels()
        self.ids: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        learned, of, encode = self.ids, self.bytes, self.auto.encode
        for w in words:
            if w not in learned:
                ids = encode(w if w.isascii() and w.isprintable() else "".join([of[b] for b in w.encode()]))
                learned[w] = struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # one character at a time: no final sigma
        return self.words(text.lower())

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        parts = self.cut.split(text) if self.cut and self.cut.search(text) else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            words = self._plain(part)
            try:
                out.append(b"".join([*map(self.ids.__getitem__, words)]))
            except KeyError:
                self._learn(words)
                out.append(b"".join([*map(self.ids.__getitem__, words)]))
        return b"".join(out)

    def decode(self, ids) -> str:
        """Labels of the arcs, joined by spaces as this vocabulary has no decoder of its own."""
        return " ".join([*map(self.labels.__getitem__, ids)])


#: Rows that a worker turns into output at a time.
ROWS = 256
_made: dict[str, Tokenizer] = {}


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _tokenizer(spec: str) -> Tokenizer:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _made:
        _made[key] = Tokenizer(spec)
    return _made[key]


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").to_pylist()


def encode(docs: DataFrame, path: str, text: str = "text", round_trip: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``token_ids`` (array of int) instead of the text.

    ``round_trip`` decodes the ids where they were made and adds ``decoded_sha256`` of the text that they give back and
    ``restored``, whether that is the text itself (null as empty); the decoded texts stay in the worker."""
    spec = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())
    made = {"n_tokens": "long", "token_ids": "array<int>", **({"decoded_sha256": "string", "restored": "boolean"} if round_trip else {})}
    others = [f for f in docs.schema.fields if f.name != text and f.name not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(spec.value)
        for batch in _parts(batches):
            raw, said, same = [], [], []
            for t in _texts(batch, text):
                raw.append(tok.encode(t))
                if round_trip:
                    back = tok.decode(np.frombuffer(raw[-1], "<u4").tolist())
                    said.append(hashlib.sha256(back.encode()).hexdigest())
                    same.append(back == t)
            ends = np.cumsum([0, *(len(x) // 4 for x in raw)])
            flat = pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in others]
            cols += [pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
            if round_trip:
                cols += [pa.array(said, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in others), *made])

    rows = docs.select(*(f.name for f in others), text)
    return to_workers(rows, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *(f"{c} {kind}" for c, kind in made.items())]))


def decode(rows: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """``rows`` with the text that ``token_ids`` decode to, instead of them or beside them; null ids give null."""
    spec = rows.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())
    others = [f for f in rows.schema.fields if f.name != "decoded" and (keep_ids or f.name != "token_ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(spec.value)
        for batch in _parts(batches):
            ids = batch.column(batch.schema.get_field_index("token_ids")).to_pylist()
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in others]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([None if x is None else tok.decode(x) for x in ids], pa.string())], names=[*(f.name for f in others), "decoded"])

    rows = rows.select(*dict.fromkeys([*(f.name for f in others), "token_ids"]))
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "decoded string"]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded text of every document."""
    spec = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(spec.value)
        for batch in _parts(batches):
            n, ids, said = [], [], []
            for t in _texts(batch, "text"):
                raw = tok.encode(t)
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                said.append(hashlib.sha256(tok.decode(np.frombuffer(raw, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(said, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return to_workers(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
