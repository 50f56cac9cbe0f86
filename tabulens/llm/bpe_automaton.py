"""BPE encoding and decoding by a tokenization automaton.

The automaton accepts exactly the token sequences that BPE gives.  It starts as
one state with a loop for every base symbol.  Merge number r of (u, v) into t
inserts one gadget: the state that u-arcs lead to is copied without its v-arc,
all u-arcs are turned to the copy, and every state that has a u-arc after that
also gets a t-arc, leading where the v-arc led.  All arcs of one label lead to
one state, so a state is named by the label read last.

States share structure: a gadget is stored as one table entry, ``cut[u][v] = r``.
The state of t starts as the state of v as it stood at time r, so its own cuts
come first, then those of v that are older than t, and so on.  A t-arc is there
if no cut on that chain removed t, or removed the left part of t before t was
built from it, and so on down to the base symbol.

A pre-split word has one accepted token sequence.  It is found from the left,
longest arc first; a position from which the word cannot be finished is never
tried again, so the work is linear in the word.  Decoding emits arc labels.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map

#: Bytes of text that are encoded at a time (a longer text alone).
PIECE_BYTES = 1 << 20
#: Words that a worker remembers in two generations; words met again move to the younger one.
MEMO = 240_000
#: Longer ones are not remembered.
LONG = 48
NEVER = 1 << 60
#: Characters whose splitting needs no Unicode normalisation and is the same in every Unicode version.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-ɏ‐-‧]*")
# Fixed value: the word pattern of the tokenizer file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it prints, else the next letter from U+0100."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in prints else chr(next(spare)) for b in range(256)}


class MergeAutomaton:
    """Tables of the automaton for a vocabulary and its merges, in order."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        size = max(vocab.values(), default=-1) + 1
        self.vocab, self.end, self.size = vocab, end, size
        self.left, self.right, self.made = [-1] * size, [-1] * size, [-1] * size
        self.cut: dict[int, dict[int, int]] = {}
        self.states = 1
        dead = set()
        for r, (a, b) in enumerate(merges):
            u, v, t = vocab[a], vocab[b], vocab[a + b]
            if self.made[t] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            self.left[t], self.right[t], self.made[t] = u, v, r
            if u in dead or v in dead or not self.arc(u, v):
                dead.add(t)  # no path has u before v: the gadget adds no arc
                continue
            self.cut.setdefault(u, {})[v] = r
            self.states += 1
        self.arc_memo: dict[int, bool] = {}
        live = {s: t for s, t in vocab.items() if t not in dead}
        #: Labels that end a word (without the mark of the end), and a trie of those inside one:
        #: a node is [label or -1, {symbol: node}].
        self.last = {s.removesuffix(end): t for s, t in live.items() if s.endswith(end)} if end else live
        self.longest_last = max(map(len, self.last), default=0)
        self.inner: list = [-1, {}]
        for s, t in live.items():
            if not (end and s.endswith(end)):
                node = self.inner
                for symbol in s:
                    node = node[1].setdefault(symbol, [-1, {}])
                node[0] = t

    def arc(self, u: int, t: int) -> bool:
        """Whether the state of u has a t-arc."""
        born, left, made = NEVER, self.left, self.made
        y = u
        while y >= 0:
            cuts = self.cut.get(y)
            if cuts:
                x, built = t, NEVER
                while x >= 0:
                    r = cuts.get(x)
                    if r is not None and r < born and r <= built:
                        return False
                    built, x = made[x], left[x]
            born, y = made[y], self.right[y]
        return True

    def has_arc(self, u: int, t: int) -> bool:
        key = u * self.size + t
        known = self.arc_memo.get(key)
        if known is None:
            if len(self.arc_memo) >= MEMO:
                self.arc_memo.clear()
            known = self.arc_memo[key] = self.arc(u, t)
        return known

    def path(self, word: str) -> tuple[int, ...]:
        """The labels of the accepted path that spells ``word`` (base symbols; the last one also ends the word)."""
        n, root, last, memo, size = len(word), self.inner[1], self.last, self.arc_memo, self.size
        tokens: list[int] = []
        waiting: list[tuple[int, list]] = []  # where each token starts, and the shorter ones to try there
        closed: set[int] = set()
        at, before, tries = 0, -1, None
        while True:
            if tries is None:
                if n - at <= self.longest_last:
                    t = last.get(word[at:])
                    if t is not None:
                        ok = before < 0 or memo.get(before * size + t)
                        if self.has_arc(before, t) if ok is None else ok:
                            tokens.append(t)
                            return tuple(tokens)
                tries, nodes = [], root
                for stop in range(at + 1, n):
                    node = nodes.get(word[stop - 1])
                    if node is None:
                        break
                    t, nodes = node
                    if t >= 0:
                        tries.append((t, stop))
            while tries:
                t, stop = tries.pop()
                if stop not in closed:
                    ok = before < 0 or memo.get(before * size + t)
                    if self.has_arc(before, t) if ok is None else ok:
                        tokens.append(t)
                        waiting.append((at, tries))
                        at, before, tries = stop, t, None
                        break
            else:
                if not tokens:
                    raise ValueError(f"no path spells {word!r}")
                closed.add(at)
                tokens.pop()
                at, tries = waiting.pop()
                before = tokens[-1] if tokens else -1

class WordTokenizer:
    """A tokenizer file of the word-end kind, encoded and decoded by its automaton."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("decoder") is not None:
            raise ValueError("a BPE tokenizer without a decoder is needed")
        library = Tokenizer.from_file(path)  # its tables go again, only these two parts are needed
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.end = model.get("end_of_word_suffix") or ""
        self.automaton = MergeAutomaton(model["vocab"], [tuple(m) for m in model["merges"]], self.end)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match the raw text as they are")
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        ids = {**{t: s for s, t in model["vocab"].items()}, **{t: s for s, t in self.added.items()}}
        self.emitted = [ids.get(i, "") for i in range(max(ids, default=-1) + 1)]
        self.letters = byte_letters()
        self.word_pattern = regex.compile(WORDS)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.mixed_memo: dict[str, tuple[int, ...]] = {}

    def word_ids(self, word: str, letters: str) -> tuple[int, ...]:
        ids = self.memo.get(word)
        if ids is None:
            ids = self.older.pop(word, None) or self.automaton.path(letters)
            if len(word) <= LONG:
                if len(self.memo) >= MEMO // 2:
                    self.older, self.memo = self.memo, {}
                self.memo[word] = ids
        return ids

    def in_letters(self, word: str) -> str:
        return word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))

    def run_ids(self, run: str) -> tuple[int, ...]:
        """Ids of a run without white space, made of PLAIN characters in lower case."""
        if run.isalpha():
            return self.word_ids(run, self.in_letters(run))
        ids = self.mixed_memo.get(run)
        if ids is None:
            words = (run[:-1], run[-1]) if run[:-1].isalpha() else self.word_pattern.findall(run)
            parts = [self.word_ids(w, self.in_letters(w)) for w in words]
            ids = tuple(itertools.chain.from_iterable(parts))
            if len(run) <= LONG:
                if len(self.mixed_memo) >= MEMO // 6:
                    self.mixed_memo.clear()
                self.mixed_memo[run] = ids
        return ids

    def segment_ids(self, text: str, out: list[int]) -> None:
        if PLAIN.fullmatch(text):
            for run in text.lower().split():
                out.extend(self.memo.get(run) or self.run_ids(run))
        else:
            normal = self.normalizer.normalize_str(text)
            for letters, _ in self.pre_tokenizer.pre_tokenize_str(normal):
                out.extend(self.word_ids("\0" + letters, letters))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.added_pattern.finditer(text):
            self.segment_ids(text[at : m.start()], out)
            out.append(self.added[m.group()])
            at = m.end()
        self.segment_ids(text[at:] if at else text, out)
        return out

    def decode(self, ids) -> str:
        return " ".join(map(self.emitted.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` (array<int>) and ``decoded`` (the labels of those ids, decoded again).

    One row per input row, repeated rows included; a null or empty text has no
    ids and decodes to an empty text.  Other columns are left out, so their
    names cannot clash.  ``path`` must name the tokenizer file on every executor.
    """
    names = [f"k{i}" for i in range(len(keep))]
    kinds = [df.schema[k].dataType.simpleString() for k in keep]
    rows = df.select(*(df[k].alias(n) for k, n in zip(keep, names)), df[text].alias("x"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(path)
        arrays, decoded = [], []
        for x in batch.column("x").to_pylist():
            ids = t.encode(x or "")
            arrays.append(np.array(ids, np.int32))
            decoded.append(t.decode(ids))
        offsets = np.zeros(len(arrays) + 1, np.int32)
        np.cumsum([len(a) for a in arrays], out=offsets[1:])
        values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.ListArray.from_arrays(offsets, values), pa.array(decoded, pa.string())],
            [*names, "ids", "decoded"],
        )

    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), "ids array<int>", "decoded string"])
    out = arrow_map(rows, work, schema, ["x"], PIECE_BYTES)
    return out.select(*(out[n].alias(k) for k, n in zip(keep, names)), "ids", "decoded")
