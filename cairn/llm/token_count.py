"""Token counts (6): rank-synchronous array merging.

A text becomes pre-tokens (a word with the space before it). Pre-tokens not counted before are laid
out together as one ragged numpy array of symbols; in every round each sequence applies its pair of
lowest rank, all sequences at once, until no pair is left. The surviving symbols are counted.

A round over whole arrays suits many short pre-tokens. Long ones, which need many rounds, are laid
out together as linked arrays with their places kept by rank: a round takes the lowest rank of all,
which is the lowest of each sequence that has it, and touches only the places that merge and their
neighbours, so that it costs what it merges.

Null and empty texts have 0 tokens. Repeated rows are counted one by one. Texts without any space,
however long, are one pre-token.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm.common import batches, column, strings

MARK = "▁"
#: Pre-tokens whose counts a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000
NO_RANK = np.iinfo(np.int64).max
#: Characters from which a pre-token goes through the rounds by rank.
LONG = 96
#: Pre-tokens, and their characters, that are laid out together.
TOGETHER, TOGETHER_CHARS = 20_000, 2_000_000


class PieceBpe:
    """Counts tokens of a sentencepiece BPE model with byte fallback, without the library's encoder."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("pieces that the user defined are not covered")
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces and train.byte_fallback):
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix are covered")
        score = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in score):
            raise ValueError("a piece spans two words")
        self.runs = {len(p) for p in score if set(p) == {MARK}} | {1}
        worst = min((s for p, s in score.items() if set(p) != {MARK}), default=0.0)
        if any(score[MARK * n] >= worst for n in self.runs if n > 1):
            raise ValueError("runs of spaces merge before words")
        words = {p: s for p, s in score.items() if len(p) == 1 or set(p) != {MARK}}
        ids = {p: i for i, p in enumerate(dict.fromkeys([*words, *(c for p in words for c in p)]))}
        self.char = {p: i for p, i in ids.items() if len(p) == 1}
        self.known = {i for p, i in ids.items() if p in score}
        rows = [(ids[p[:k]] * len(ids) + ids[p[k:]], -words[p], ids[p]) for p in words if len(p) > 1 for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        rows.sort()
        order = {r: k for k, r in enumerate(sorted({r for _, r, _ in rows}))}
        self.size = len(ids)
        self.pair = np.array([r[0] for r in rows], dtype=np.int64)
        self.rank = np.array([order[r[1]] for r in rows], dtype=np.int64)
        self.into = np.array([r[2] for r in rows], dtype=np.int64)
        self.mark = ids.get(MARK, -1)
        self.memo: dict[str, tuple[int, int]] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs and what they merge into; NO_RANK where they don't."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.rank[at], NO_RANK), np.where(hit, self.into[at], -1)

    def _laid_out(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all words one after another, a mark put before each; the word of each symbol; what it costs if it stays alone."""
        flat = "".join(MARK + w for w in words)
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        uniq, back = np.unique(codes, return_inverse=True)
        # -2 and below: characters that no piece holds; they end as one token a byte
        width = [len(chr(c).encode("utf-8", "surrogatepass")) for c in uniq]
        as_id = np.array([self.char[chr(c)] if chr(c) in self.char else -1 - w for c, w in zip(uniq.tolist(), width, strict=True)], dtype=np.int64)
        alone = np.array([1 if chr(c) in self.char and self.char[chr(c)] in self.known else w for c, w in zip(uniq.tolist(), width, strict=True)], dtype=np.int64)
        return as_id[back], np.repeat(np.arange(len(words)), [len(w) + 1 for w in words]), alone[back]

    def merged(self, words: list[str]) -> list[tuple[int, int]]:
        """(tokens, 1 if the leading mark stays alone) for each word, a mark put before it."""
        sym, seq, cost = self._laid_out(words)
        done_count, done_lead = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)

        def close(keep: np.ndarray) -> None:
            nonlocal sym, seq, cost
            gone = ~keep[seq]
            if gone.any():
                done_count[:] += np.bincount(seq[gone], weights=cost[gone], minlength=len(words)).astype(np.int64)
                first = gone & np.r_[True, seq[1:] != seq[:-1]]
                done_lead[seq[first]] = sym[first] == self.mark
                sym, seq, cost = sym[~gone], seq[~gone], cost[~gone]

        while len(sym):
            n = len(sym)
            rank, into = np.full(n, NO_RANK), np.full(n, -1)
            if n > 1:
                r, t = self._ranks(sym[:-1], sym[1:])
                same = seq[:-1] == seq[1:]
                rank[:-1], into[:-1] = np.where(same, r, NO_RANK), t
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, starts)
            active = np.zeros(len(words), dtype=bool)
            active[seq[starts]] = low < NO_RANK
            if not active.any():
                close(active)
                break
            lowest = np.repeat(low, np.diff(np.r_[starts, n]))
            chosen = (rank == lowest) & (rank < NO_RANK)
            # of overlapping places of one pair, every second from the left
            at = np.flatnonzero(chosen)
            run = np.r_[True, np.diff(at) > 1]
            head = np.maximum.accumulate(np.where(run, at, 0))
            at = at[(at - head) % 2 == 0]
            # All at once only if no pair that arises on the way would go before the rest.
            new = into[at]
            after = np.where(at + 2 < n, sym[np.minimum(at + 2, n - 1)], -1)
            after = np.where((at + 2 < n) & (seq[np.minimum(at + 2, n - 1)] == seq[at]), after, -1)
            taken = np.full(n, -1)
            taken[at] = new
            left = np.where(at > 0, np.where((at > 1) & (taken[np.maximum(at - 2, 0)] >= 0), taken[np.maximum(at - 2, 0)], sym[np.maximum(at - 1, 0)]), -1)
            left = np.where((at > 0) & (seq[np.maximum(at - 1, 0)] == seq[at]), left, -1)
            early = np.minimum(self._ranks(new, after)[0], self._ranks(left, new)[0]) <= rank[at]
            single = np.zeros(len(words), dtype=bool)
            single[seq[at[early]]] = True
            first = np.r_[True, seq[at[1:]] != seq[at[:-1]]]
            at = at[~single[seq[at]] | first]
            sym[at], cost[at] = into[at], 1
            stay = np.ones(n, dtype=bool)
            stay[at + 1] = False
            sym, seq, cost = sym[stay], seq[stay], cost[stay]
            close(active)
        return list(zip(done_count.tolist(), done_lead.tolist(), strict=True))

    def merged_by_rank(self, words: list[str]) -> list[tuple[int, int]]:
        """As merged(), for long words: places are kept by rank, and a round touches only what it merges."""
        sym, seq, cost = self._laid_out(words)
        n = len(sym)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, dtype=bool)
        after[np.r_[seq[1:] != seq[:-1], True]] = n  # n: the sequence ends here
        before[np.r_[True, seq[1:] != seq[:-1]]] = n
        sym, seq = np.r_[sym, -1], np.r_[seq, -1]  # place n is beyond every end
        rank, into = np.full(n + 1, NO_RANK), np.full(n + 1, -1)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(at: np.ndarray) -> None:
            """Put the pairs that begin at these places where their ranks are."""
            rank[at], into[at] = self._ranks(sym[at], sym[after[at]])
            at = at[rank[at] < NO_RANK]
            if not len(at):
                return
            own = rank[at]
            order = np.argsort(own, kind="stable")
            at, own = at[order], own[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for r, part in zip(own[first].tolist(), np.split(at, first[1:]), strict=True):
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(part)

        note(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            # of overlapping places of one pair, every second from the left
            k = np.arange(len(at))
            head = np.maximum.accumulate(np.where(np.r_[True, after[at[:-1]] != at[1:]], k, 0))
            at = at[(k - head) % 2 == 0]
            # From left to right, the neighbours of a place as they are when it merges. A pair that then
            # arises and goes before this rank stops its sequence: what is left of the rank comes again.
            new, right = into[at], after[after[at]]
            left = before[at]
            joined = np.r_[False, after[after[at[:-1]]] == at[1:]]
            left_sym = np.where(joined, np.r_[-1, new[:-1]], sym[left])
            early = np.minimum(self._ranks(new, sym[right])[0], self._ranks(left_sym, new)[0]) <= r
            if early.any():
                behind = np.cumsum(early) - early
                start = np.flatnonzero(np.r_[True, seq[at[1:]] != seq[at[:-1]]])
                held = behind > np.repeat(behind[start], np.diff(np.r_[start, len(at)]))
                if held.any():
                    places[r] = [at[held]]
                    heapq.heappush(ranks, r)
                    at = at[~held]
            gone = after[at]
            sym[at], cost[at] = into[at], 1
            alive[gone] = False
            rank[gone] = NO_RANK
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            note(np.unique(np.r_[at, before[at][before[at] < n]]))
        counts = np.bincount(seq[:n][alive], weights=cost[alive], minlength=len(words)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, seq[1:n] != seq[: n - 1]])
        return list(zip(counts.tolist(), (sym[first] == self.mark).astype(int).tolist(), strict=True))

    @functools.lru_cache(maxsize=4096)  # noqa: B019
    def run(self, n: int) -> int:
        """Tokens of n marks that no word takes: the leftmost pair that is a piece merges first."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                stack[-2:] = [stack[-2] + stack[-1]]
        return len(stack)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as the library's encode gives them."""
        split = [t.replace(MARK, " ").split(" ") if t else [] for t in texts]
        memo = self.memo
        if len(memo) > REMEMBERED:
            memo.clear()
        new = {w for words in split for w in words if w not in memo}
        fresh: dict[str, tuple[int, int]] = {}
        for way, own in ((self.merged, [w for w in new if len(w) < LONG]), (self.merged_by_rank, [w for w in new if len(w) >= LONG])):
            for part in _together(own):
                fresh.update(zip(part, way(part), strict=True))
        memo.update((w, x) for w, x in fresh.items() if len(w) <= 64)
        out = []
        for words in split:
            total = empty = 0
            for w in words:
                if not w:
                    empty += 1
                    continue
                n, lead = memo.get(w) or fresh[w]
                total += n
                if empty:
                    total += self.run(empty + lead) - lead
                    empty = 0
            out.append(total + (self.run(empty) if empty else 0))
        return out


def _together(words: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for w in words:
        held.append(w)
        size += len(w)
        if len(held) == TOGETHER or size >= TOGETHER_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


@functools.lru_cache(maxsize=2)
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_bytes, n_tokens, over_limit (more tokens than limit).

    Null texts count as empty (0 tokens). Other columns are left out, so names can't clash. An empty table gives an empty result. The model
    file must be at model_path on each executor. No shuffle.
    """

    def count(part: pa.RecordBatch) -> dict:
        own = strings(part, "text_")
        n = piece_bpe(model_path).counts(own)
        return {id_col: column(part, "id_"), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in own], "n_tokens": n, "over_limit": [x > limit for x in n]}

    rows = docs.select(docs[id_col].cast("long").alias("id_"), docs[text_col].cast("string").alias("text_"))
    return batches(rows, count, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
