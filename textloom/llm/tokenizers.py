"""Public tokenizers, loaded once per worker process, and the linear-time byte-pair encoder."""

from __future__ import annotations

import base64
import functools
import os

#: Folder of the vocabulary files, a parameter of every query that encodes; never copied into this repository.
DEFAULT_FOLDER = os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")
#: The split pattern that belongs to the rank files (a fixed value of the vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens up to so many bytes are remembered; longer ones (rare, hardly repeated) are encoded each time.
REMEMBERED_BYTES = 64
#: Entries after which a worker's memory of which tokens accept each other is emptied.
REMEMBERED_PAIRS = 2_000_000
#: Entries after which a worker's memory of pre-tokens is emptied, so that it stays within about 100 MB.
REMEMBERED_WORDS = 400_000


class BacktrackEncoder:
    """Exact byte-pair encoding in linear time.

    Tokens are matched by an Aho-Corasick automaton over Latin-1 images of the bytes. A position takes the longest token
    whose neighbour to the left accepts it; when none is left, the encoder steps back and marks the position as a dead end, so no
    position is tried twice. Two adjacent tokens accept each other when merging their bytes from scratch keeps the cut between
    them; that test walks down the merges of both tokens and its answers are remembered.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.split = regex.compile(SPLIT).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                left, right = self._last_merge(token, rank)
                self.parts[rank] = (left, right)
                self.merged[left, right] = rank
        self.accepted: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge gives TOKEN: what is left when only merges of a lower rank are applied."""
        pieces = [token[i : i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            best, at = min(((self.ranks.get(pieces[i] + pieces[i + 1], rank), i) for i in range(len(pieces) - 1)))
            if best >= rank:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        if len(pieces) != 2:
            raise ValueError(f"the vocabulary has no merge that gives token {rank}")
        return self.ranks[pieces[0]], self.ranks[pieces[1]]

    def accepts(self, left: int, right: int) -> bool:
        """Whether LEFT and RIGHT may stand beside each other in an encoding."""
        key = (left, right)
        known = self.accepted.get(key)
        if known is None:
            if len(self.accepted) >= REMEMBERED_PAIRS:
                self.accepted.clear()
            known = self.accepted[key] = self._cut_holds(left, right)
        return known

    def _cut_holds(self, left: int, right: int) -> bool:
        # Undo the later of the two inner merges again and again: whatever pair then meets at the cut must not merge before the merges undone so far.
        before = len(self.ranks) + 1
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < before:
                return False
            split_left, split_right = self.parts.get(left), self.parts.get(right)
            if split_left and (not split_right or left > right):
                before, left = left, split_left[1]
            elif split_right:
                before, right = right + 1, split_right[0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (rank, length) in self.automaton.iter(piece.decode("latin-1")):
            starting[end - length + 1].append((length, rank))
        choice = [len(s) - 1 for s in starting]  # matches come by their end, so the longest of a start is last
        dead = bytearray(n + 1)
        ids: list[int] = []
        at: list[int] = []
        pos = 0
        while pos < n:
            k = choice[pos]
            options = starting[pos]
            while k >= 0:
                length, rank = options[k]
                if not dead[pos + length] and (not ids or self.accepts(ids[-1], rank)):
                    break
                k -= 1
            if k >= 0:
                choice[pos] = k
                ids.append(rank)
                at.append(pos)
                pos += length
            else:
                dead[pos] = 1
                choice[pos] = len(options) - 1
                ids.pop()
                pos = at.pop()
                choice[pos] -= 1
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of TEXT without special tokens; [] for None and for the empty text."""
        if not text:
            return []
        known, out = self.known, []
        for word in self.split(text):
            ids = known.get(word)
            if ids is None:
                raw = word.encode("utf-8", "surrogatepass")
                ids = self.encode_piece(raw)
                if len(raw) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED_WORDS:
                        known.clear()
                    known[word] = ids
            out += ids
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def backtrack_encoder(path: str) -> BacktrackEncoder:
    """The encoder of a rank file, built once per process."""
    return BacktrackEncoder(read_ranks(path))


@functools.lru_cache(maxsize=2)
def batch_encoder(path: str):
    """The encoder of a vocabulary file (tokenizers, tiktoken or sentencepiece by its ending) as a function from texts to lists of ids."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".tiktoken"):
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=read_ranks(path), special_tokens={})
        return lambda texts: [encoding.encode_ordinary(x) for x in texts]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: pieces.encode(texts, num_threads=1)
    raise ValueError(f"no tokenizer library reads {path}")
