"""SentencePiece BPE encoding by vectorised merge rounds.

A text is cut into words (a run of spaces with what follows up to the next space); no piece of such
a vocabulary reaches over a word's start. All distinct words of a batch lie in flat numpy arrays of
symbols. In each round every word finds the smallest rank among its pairs of neighbours (a segmented
minimum; ties go to the leftmost), all words merge that one pair at once, and the arrays are compacted.
Words without a pair leave the rounds. One pair per word and round is what the library's agenda does,
since words cannot influence each other.

Words of more than ``LONG`` symbols would need as many rounds; they are merged with a heap instead,
with the same result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 256
CACHE = 200_000  # distinct words that a worker remembers
TEXTS = 2 << 20  # characters of text that are encoded together
_WORD = re.compile(" *[^ ]+| +")
_NONE = np.int64(1) << 62


class Encoder:
    """Same identifiers as the library's ``encode``, for BPE models with byte fallback.

    The model must add a leading space, keep all white space and leave other characters as they are.
    """

    def __init__(self, model_file: str):
        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        pieces = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if any("▁" in p.lstrip("▁") for p in pieces) or not all(sp.is_byte(int(i)) for i in self.bytes):
            raise ValueError("pieces must hold spaces only in front, and bytes must have pieces of their own")
        if sp.normalize("ﬁ  a") not in ("▁ﬁ▁▁a", "ﬁ▁▁a"):
            raise ValueError("the model changes characters")
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        # symbols: pieces, then the characters that are no piece themselves
        self.chars = {p: i for p, i in pieces.items() if len(p) == 1}
        self.extra = n
        for c in sorted({c for p in pieces for c in p} - set(self.chars)):
            self.chars[c] = n
            n += 1
        self.spelled: dict[int, str] = {i: c for c, i in self.chars.items() if i >= self.extra}
        symbols = pieces | self.chars
        merges = sorted(
            (symbols[p[:cut]] << 32 | symbols[p[cut:]], i) for p, i in pieces.items() for cut in range(1, len(p)) if p[:cut] in symbols and p[cut:] in symbols
        )
        self.pairs = np.array([m for m, _ in merges] + [_NONE])
        self.merged = np.array([i for _, i in merges] + [-1])
        scores = np.array([sp.get_score(int(i)) for i in self.merged[:-1]])
        self.rank = np.append(np.unique(-scores, return_inverse=True)[1], _NONE)  # equal scores have equal ranks
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Positions in the pair table; the last one means no pair."""
        wanted = left << 32 | right
        at = np.searchsorted(self.pairs, wanted)
        return np.where(self.pairs[at] == wanted, at, len(self.pairs) - 1)

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and their words, sorted by word."""
        out_symbols, out_words = [], []
        last = len(self.pairs) - 1
        pair = np.full(len(symbols), last)  # of each symbol with its right neighbour
        if len(symbols) > 1:
            pair[:-1] = np.where(word[:-1] == word[1:], self._look_up(symbols[:-1], symbols[1:]), last)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lengths = np.diff(np.append(starts, len(word)))
            rank = self.rank[pair]
            low = np.minimum.reduceat(rank, starts)
            going = np.repeat(low < _NONE, lengths)
            if not going.all():
                out_symbols.append(symbols[~going])
                out_words.append(word[~going])
                symbols, word, pair, rank = symbols[going], word[going], pair[going], rank[going]
                keep = low < _NONE
                low, lengths = low[keep], lengths[keep]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == np.repeat(low, lengths))
            hit_words = word[hits]
            at = hits[np.concatenate(([True], hit_words[1:] != hit_words[:-1]))]  # the leftmost of each word
            symbols[at] = self.merged[pair[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # one symbol goes in each word before
            symbols, word, pair = symbols[stay], word[stay], pair[stay]
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(symbols) - 1)
                same = (word[left] == word[right]) & (right > left)
                pair[left] = np.where(same, self._look_up(symbols[left], symbols[right]), last)
        if not out_symbols:
            return symbols, word
        symbols, word = np.concatenate(out_symbols), np.concatenate(out_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _heap(self, symbols: list[int]) -> list[int]:
        """The same merges for one long word, with a heap of pairs."""
        n = len(symbols)
        nexts, befores = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self._table()
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if 0 <= i and j < n and (found := table.get(symbols[i] << 32 | symbols[j])):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nexts[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, -1
            nexts[i] = nexts[j]
            if nexts[i] < n:
                befores[nexts[i]] = i
            push(befores[i], i)
            push(i, nexts[i])
        return [s for s in symbols if s >= 0]

    @lru_cache(1)  # noqa: B019
    def _table(self) -> dict[int, tuple[int, int]]:
        return {int(p): (int(r), int(m)) for p, r, m in zip(self.pairs[:-1], self.rank[:-1], self.merged[:-1])}

    def _learn(self, words: list[str]) -> None:
        """Encode words that are not known yet and append them to the flat store."""
        spelled = [w.replace(" ", "▁") for w in words]
        codes = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds, which = np.unique(codes, return_inverse=True)
        fresh = {}
        for c in map(chr, kinds.tolist()):
            if c not in self.chars:  # a character no piece has: a symbol for this call only
                fresh[c] = self.extra + len(self.spelled) + len(fresh)
        spelling = self.spelled | {i: c for c, i in fresh.items()}
        symbols = np.array([self.chars.get(chr(c), fresh.get(chr(c), 0)) for c in kinds.tolist()], np.int64)[which]
        lengths = np.array([len(w) for w in spelled])
        word = np.repeat(np.arange(len(words)), lengths)
        long = lengths > LONG
        slow = np.repeat(long, lengths)
        done, owner = self._rounds(symbols[~slow], word[~slow])
        if long.any():
            ends = np.cumsum(lengths)
            parts = [(i, self._heap(symbols[ends[i] - lengths[i]:ends[i]].tolist())) for i in np.flatnonzero(long)]
            done = np.concatenate([done, *[np.array(p, np.int64) for _, p in parts]])
            owner = np.concatenate([owner, *[np.full(len(p), i) for i, p in parts]])
            order = np.argsort(owner, kind="stable")
            done, owner = done[order], owner[order]
        odd = np.flatnonzero(done >= self.extra)
        if len(odd):  # bytes for what has no piece
            octets = [self.bytes[np.frombuffer(spelling[int(s)].encode("utf-8", "surrogatepass"), np.uint8)] for s in done[odd]]
            more = np.ones(len(done), np.int64)
            more[odd] = [len(o) for o in octets]
            owner, wide = np.repeat(owner, more), np.repeat(done, more)
            wide[np.repeat(done >= self.extra, more)] = np.concatenate(octets)
            done = wide
        base = len(self.known)
        self.known.update((w, base + i) for i, w in enumerate(words))
        self.ends = np.append(self.ends, len(self.flat) + np.cumsum(np.bincount(owner, minlength=len(words))))
        self.flat = np.concatenate([self.flat, done.astype(np.int32)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Identifiers of each text, without begin and end."""
        words = [_WORD.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
        distinct = set().union(*words)
        if len(self.known) > CACHE:
            self._forget()
        new = sorted(distinct.difference(self.known))
        if new:
            self._learn(new)
        counts = np.array([len(w) for w in words])
        at = np.fromiter((self.known[w] for ws in words for w in ws), np.int64, counts.sum())
        starts = self.ends[at]
        lengths = self.ends[at + 1] - starts
        total = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.flat[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])]
        return np.split(ids, total[np.cumsum(counts)[:-1]]) if len(texts) else []

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(2)
def encoder(model_file: str) -> Encoder:
    """One per worker process."""
    return Encoder(model_file)


def _encode(batches: Iterator[pa.RecordBatch], model_file: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    own = encoder(model_file)

    def settle(ids: list, texts: list[str]) -> pa.RecordBatch:
        columns = {"doc_id": pa.array(ids), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        full = [np.concatenate(([own.bos], x, [own.eos])).astype("<u4") for x in own.encode(texts)]
        columns["n_tokens"] = pa.array([len(x) for x in full], pa.int64())
        columns["ids_sha256"] = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in full], pa.string())
        columns["decoded_sha256"] = pa.array([hashlib.sha256(own.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in full], pa.string())
        if with_ids:
            columns["ids"] = pa.array([x.astype(np.int32) for x in full], pa.list_(pa.int32()))
        return columns

    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        at = 0
        while at < len(texts):  # groups of texts of bounded size, at least one text each
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= TEXTS):
                size += len(texts[end])
                end += 1
            columns = settle([], texts[at:end])
            columns["doc_id"] = batch.column(0).slice(at, end - at)
            yield pa.record_batch(list(columns.values()), names=list(columns))
            at = end


def tokenise(
    docs: DataFrame, model_file: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``).

    Whole texts with begin and end identifiers, null as empty; ``ids_sha256`` is over little-endian
    unsigned 32-bit numbers, ``decoded_sha256`` over the text decoded from them. ``model_file`` must
    be readable on all executors. Rows are independent of each other. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(partial(_encode, model_file=model_file, with_ids=with_ids), schema + (", ids array<int>" if with_ids else ""))
