"""BPE by a tokenization automaton.

The automaton reads tokens: a state stands for the token just read, and has an arc for each token that may follow it in a
correct tokenization.  It begins as the automaton of all byte strings, and each merge (a, b) -> c of the vocabulary, in
order, applies one gadget: wherever an arc a leads to a state with an arc b, an arc c is added beside it, leading to a
copy of b's state; and the arc b is cut from a's state.  (Where a and b are the same, a's own state gets no arc c, for
a run of three merges from the left.)  What is left after all merges accepts exactly one token sequence for each byte
string: the tokenizer's.

Copies would take a state's arcs times the vocabulary, so states are kept as what the gadgets did: the state that each
was copied from and when, the arc that each arc was put beside and when, and when an arc was cut.  `follows` walks this
history.  What is compiled are tables that read the arcs' labels letter by letter; encoding drives these and the table of
the transitions that have been asked for, decoding emits the labels.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import documents
from runweave.llm.token_ids import SEEN, UnitEncoder, byte_letters, slices, text_slices, units_of, vocabulary_path

NEVER = 1 << 40


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values(), default=-1) + 1
        self.vocab = vocab
        self.copied = list(range(size))  # state that a state was copied from
        self.beside = list(range(size))  # arc that an arc was put beside
        self.born = [-1] * size
        self.cut: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        self.dead: set[int] = set()
        for k, (x, y) in enumerate(merges):
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            if self.born[c] >= 0:
                raise ValueError(f"two merges make {x + y!r}")
            if a in self.dead or b in self.dead or not self.follows(a, b, k):
                self.dead.add(c)  # no path reads a and then b any more: the gadget adds no arc
            self.copied[c], self.beside[c], self.born[c] = b, a, k
            self.cut.setdefault(a << 32 | b, k)
        letters = {c: b for b, c in byte_letters().items()}
        self.labels = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self._compile()

    def follows(self, state: int, arc: int, time: int = NEVER) -> bool:
        """Has `state` the arc `arc` when the merges before `time` have been applied?"""
        born, cut = self.born, self.cut
        while True:
            if cut.get(state << 32 | arc, NEVER) < time:
                return False
            s, a = born[state], born[arc]
            if s == a:
                if s < 0:
                    return True
                time, state, arc = s, self.copied[state], self.beside[arc]
            elif s > a:
                time, state = s, self.copied[state]
            else:
                if self.beside[arc] == state == self.copied[arc]:
                    return False
                time, arc = a, self.beside[arc]

    def _compile(self) -> None:
        """Tables that read labels letter by letter: a node's next node for a letter, and the arc whose label ends at a node."""
        self.nodes: list[dict[str, int]] = [{}]
        self.arcs = [-1]
        for label, arc in self.vocab.items():
            if arc in self.dead:
                continue
            node = 0
            for letter in label:
                onward = self.nodes[node].get(letter)
                if onward is None:
                    onward = self.nodes[node][letter] = len(self.nodes)
                    self.nodes.append({})
                    self.arcs.append(-1)
                node = onward
            self.arcs[node] = arc

    def encode(self, letters: str) -> list[int]:
        """Ids of a pre-split part.  What has been read leads to exactly one state, so one pass of transitions over the letters
        finds the state after each of them: from a state, labels are read in the tables, and an arc is taken if the state has
        it (transitions that have been asked for once are in a table, too)."""
        nodes, arcs, table, n = self.nodes, self.arcs, self.table, len(letters)
        state, begun = [-1] * (n + 1), [0] * (n + 1)
        for at in range(n):
            here, node = state[at], 0
            if at and here < 0:
                continue
            for end in range(at, n):
                node = nodes[node].get(letters[end])
                if node is None:
                    break
                arc = arcs[node]
                if arc < 0 or state[end + 1] >= 0:
                    continue
                if at:
                    edge = here << 32 | arc
                    ok = table.get(edge)
                    if ok is None:
                        if len(table) > 2_000_000:
                            table.clear()
                        ok = table[edge] = self.follows(here, arc)
                    if not ok:
                        continue
                state[end + 1], begun[end + 1] = arc, at
        if n and state[n] < 0:
            raise ValueError(f"no arcs read {letters!r}")
        out, end = [], n
        while end:
            out.append(state[end])
            end = begun[end]
        return out[::-1]


class AutomatonEncoder(UnitEncoder):
    """Encodes and decodes as the tokenizers library does with a byte-level BPE file."""

    def __init__(self, path: str, seen: int = SEEN):
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        model, pre = conf["model"], conf["pre_tokenizer"] or {}
        if model["type"] != "BPE" or conf["normalizer"] is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without a normalizer is compiled")
        added = {a["content"]: a["id"] for a in conf["added_tokens"]}
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in conf["added_tokens"]):
            raise ValueError("added tokens that take in white space or need whole words are not compiled")
        super().__init__(1 + max([*model["vocab"].values(), *added.values()]), tuple(added), seen)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        self.added_ids = added
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else lambda t: [t]
        self.labels = [b""] * self.size
        for i, label in self.automaton.labels.items():
            self.labels[i] = label
        for text, i in added.items():
            self.labels[i] = text.encode()
        self.decimal = [str(k) for k in range(self.size)]

    def _bpe(self, letters: str) -> bytes:
        each = self.each
        return b"".join([each[t] for t in self.automaton.encode(letters)])

    def _odd(self, unit: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.pieces_of(unit)))

    def _whole(self, text: str) -> bytes:
        out = []
        for k, section in enumerate(self.split_added(text)):
            if k % 2:
                out.append(self.each[self.added_ids[section]])
            elif section:
                out.append(self._units(units_of(section, ())))
        return b"".join(out)

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode(text), self.dtype).tolist()

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels one after the other."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[str, AutomatonEncoder] = {}


def automaton_encoder(path: str) -> AutomatonEncoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = AutomatonEncoder(path)
    return _ENCODERS[path]


def encode_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) of each whole text; null and empty texts have none.  Null keys and repeated rows stay as they
    are, an empty table gives an empty result, other columns are not looked at."""

    def run(batches):
        tool = automaton_encoder(path)
        for batch in batches:
            for part in text_slices(batch, 1):
                ids, sizes = tool.encode_many(part.column(1))
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))], names=[key, "ids"])

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"`{key}` long, ids array<int>")


def decode_ids(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text of each list of ids; null ids give a null text."""

    def run(batches):
        tool = automaton_encoder(path)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else tool.decode(x) for x in part.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(F.col(key).cast("long").alias(key), ids).mapInArrow(run, f"`{key}` long, text string")


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of encode_texts() and decode_ids() in one pass: key, n_tokens, ids_sha256, decoded_sha256.

    A null text is an empty one, with no ids; null keys and repeated rows stay as they are, an empty table gives an empty result,
    other columns are not looked at."""

    def run(batches):
        tool = automaton_encoder(path)
        for batch in batches:
            for part in text_slices(batch, 1):
                ids, sizes = tool.encode_many(part.column(1))
                rows, at = [], 0
                for n in sizes.tolist():
                    own, at = ids[at : at + n].tolist(), at + n
                    listed = ",".join(map(tool.decimal.__getitem__, own))
                    rows.append((n, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(tool.decode(own).encode()).hexdigest()))
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir):
    """Every whole text encoded and decoded again."""
    return round_trip(documents(spark, sf_dir), vocabulary_path())
